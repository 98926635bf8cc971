"""Model calls as a pluggable operator: prompts, batched calls inside mapInPandas, JSON picked from answers, tolerant values, retries, ledgers."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ontoloom.operators import tables as tb


class Labeller(Protocol):
    """Answers prompts; made once per worker from a picklable factory, so that models are loaded where they run."""

    def __call__(self, prompts: list[str]) -> list[str]: ...


_MADE: dict[str, Labeller] = {}
_READER = json.JSONDecoder()


def model_key(name: str, factory: Callable[[], Labeller]) -> str:
    """What tells one model from another in a worker: the name and the content of the factory, taken on the driver."""
    return f"{name}-{hashlib.md5(cloudpickle.dumps(factory)).hexdigest()}"


def worker_singleton(key: str, factory: Callable[[], Labeller]) -> Labeller:
    """One model per key and worker process, made at first use."""
    if key not in _MADE:
        _MADE[key] = factory()
    return _MADE[key]


def rule_labeller() -> Labeller:
    """A deterministic stand-in: answers with JSON made from the last quoted term of the prompt."""

    def answer(prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            term = (re.findall(r'"([^"]*)"', p) or [""])[-1]
            tech = bool(re.search(r"[_.]|\d", term))
            out.append(json.dumps({"term": term, "ontology_role": "instance" if tech else "class", "confidence": 0.9 if term else 0.0, "is_hpc_domain_term": bool(term), "decision": "accept" if term else "reject"}))
        return out

    return answer


def rule_lister() -> Labeller:
    """A stand-in that lists the pairs of neighbouring longer words, and words with signs, of the prompt's last input."""

    def answer(prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            text = p.rpartition("Input:")[2].partition("\nOutput:")[0]
            found = re.findall(r"[A-Za-z]+[_.][\w.]*\w|[a-z]{4,} [a-z]{4,}", text)
            out.append(json.dumps({"terms": list(dict.fromkeys(found))[:25]}))
        return out

    return answer


def _numbered(prompt: str) -> list[tuple[int, str]]:
    return [(int(n), t.strip().lower()) for n, t in re.findall(r"(?m)^(\d+): (.+)$", prompt)]


def rule_linker() -> Labeller:
    """A stand-in that links numbered terms to those which they end with."""

    def answer(prompts: list[str]) -> list[str]:
        return [json.dumps({"is_a_edges": [{"child_idx": i, "parent_idx": j} for i, a in t for j, b in t if a.endswith(b.rpartition(" ")[2]) and i != j and len(a) > len(b)]}) for t in map(_numbered, prompts)]

    return answer


def rule_relater() -> Labeller:
    """A stand-in that says of neighbouring numbered terms that they are used with each other."""

    def answer(prompts: list[str]) -> list[str]:
        return [json.dumps({"relations": [{"subject_idx": a[0], "predicate": "used_with", "object_idx": b[0], "relation_type": "usage"} for a, b in zip(t, t[1:])]}) for t in map(_numbered, prompts)]

    return answer


def rule_writer() -> Labeller:
    """A stand-in that declares a class for each longer word pair of the text and puts the pairs under their last word."""

    def answer(prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            pairs = list(dict.fromkeys(re.findall(r"\b([a-z]{4,}) ([a-z]{4,})\b", p.partition("\n")[2])))[:10]
            lines = [f"hpc:{a}_{b} a owl:Class ;\n  rdfs:subClassOf hpc:{b} ." for a, b in pairs]
            out.append("```turtle\n" + "\n\n".join(lines) + "\n```")
        return out

    return answer


def generate(df: DataFrame, prompt: str, factory: Callable[[], Labeller], name: str = "labeller", batch: int = 8, max_chars: int | None = None, output: str = "answer") -> DataFrame:
    """``df`` with the model's answer to each prompt, in batches; prompts over ``max_chars`` lose their beginning (left truncation). Null prompts get null."""

    key_of_model = model_key(name, factory)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = worker_singleton(key_of_model, factory)
        for b in batches:
            answers: list[str | None] = [None] * len(b)
            todo = [i for i, p in enumerate(b[prompt]) if p is not None]
            todo.sort(key=lambda i: len(b[prompt].iloc[i]))
            for at in range(0, len(todo), batch):
                part = todo[at : at + batch]
                texts = [b[prompt].iloc[i] for i in part]
                for i, a in zip(part, model([t if max_chars is None else t[-max_chars:] for t in texts]), strict=True):
                    answers[i] = a
            yield b.assign(**{output: answers})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, `{output}` string")


def prompt_column(template: str, **columns: str):
    """A prompt from a template with {names}, filled from columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.coalesce(F.col(columns.get(p, p)).cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def indexed_list(terms):
    """'0: a\\n1: b' from an array column: the candidates of a prompt with the numbers that the answer refers to."""
    return F.array_join(F.transform(terms, lambda t, i: F.concat(i.cast("string"), F.lit(": "), t)), "\n")


# --- picking JSON --------------------------------------------------------------------------------------------------------------


def json_objects(text: str) -> list[str]:
    """The JSON objects of a text as they stand there, from left to right; one inside another is part of it. Braces that open no object are passed over."""
    out, at = [], text.find("{")
    while at >= 0:
        try:
            _, end = _READER.raw_decode(text, at)
            out.append(text[at:end])
        except (ValueError, RecursionError):
            end = at + 1
        at = text.find("{", end)
    return out


def pick_json(text: str | None, which: str = "first") -> str | None:
    """The first or last JSON object of an answer, null if there is none."""
    good = json_objects(text or "")
    return good[0 if which == "first" else -1] if good else None


@F.pandas_udf(T.StringType())
def first_json_udf(s: pd.Series) -> pd.Series:
    return s.map(pick_json)


@F.pandas_udf(T.StringType())
def last_json_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda t: pick_json(t, "last"))


def parse_terms(text: str | None, limit: int = 25) -> list[str]:
    """The terms of an answer: a JSON object with 'terms', a JSON array, or, where neither parses, the quoted strings."""
    for o in [pick_json(text), *(re.findall(r"(?s)\[.*?\]", text or ""))]:
        try:
            v = json.loads(o) if o else None
        except ValueError:
            continue
        v = v.get("terms") if isinstance(v, dict) else v
        if isinstance(v, list):
            return [t.strip() for x in v if isinstance(t := x.get("term") if isinstance(x, dict) else x, str) and t.strip()][:limit]
    return [t.strip() for t in re.findall(r'"([^"\n]{2,80})"', text or "") if t.strip() and t != "terms"][:limit]


@F.pandas_udf(T.ArrayType(T.StringType()))
def parse_terms_udf(s: pd.Series) -> pd.Series:
    return s.map(parse_terms)


def to_bool(c):
    """Tolerant boolean: true, yes, 1, y; false, no, 0, n; else null."""
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isin("true", "yes", "1", "y"), True).when(s.isin("false", "no", "0", "n"), False)


def to_confidence(c):
    """Tolerant confidence in 0..1: values over 1 up to 10 are tenths, up to 100 per cent; unreadable ones 0."""
    v = F.coalesce(F.regexp_replace(c.cast("string"), "[%\\s]", "").try_cast("double"), F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(v > 10, v / 100).when(v > 1, v / 10).otherwise(v)))


def with_retries(df: DataFrame, prompt: str, factory: Callable[[], Labeller], check: Callable[[str | None], str | None], attempts: int = 3, output: str = "answer") -> DataFrame:
    """As ``generate``; an answer that ``check`` finds fault with is asked for again with the fault, up to ``attempts`` times. Adds ``error`` (null if good)."""

    key_of_model = model_key("retry", factory)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = worker_singleton(key_of_model, factory)
        for b in batches:
            answers, errors = [], []
            for p in b[prompt]:
                ask, a, e = p, None, "no prompt"
                for _ in range(attempts if p is not None else 0):
                    a = model([ask])[0]
                    e = check(a)
                    if e is None:
                        break
                    ask = f"{p}\n\nThe last answer was wrong: {e}\nAnswer again."
                answers.append(a), errors.append(e)
            yield b.assign(**{output: answers, "error": errors})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, `{output}` string, error string")


def run_pending(units: DataFrame, done: DataFrame, keys: list[str], prompt: str, factory: Callable[[], Labeller], parse: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """A stage of model calls over the units without an entry in the ledger ``done``: (parsed rows, new ledger rows)."""
    answered = generate(tb.pending(units, done, keys), prompt, factory)
    return parse(answered), tb.ledger(answered, keys, F.when(F.col("answer").isNull(), "skipped").otherwise("done"))


def few_shot(system: str, examples: list[dict], question, chat: bool = False):
    """A prompt column: the instruction, the examples (input, output) and the question; with ``chat`` as JSON messages by role."""
    if not chat:
        head = "".join(f"Input: {e['input']}\nOutput: {e['output']}\n\n" for e in examples)
        return F.concat(F.lit(f"{system.strip()}\n\n{head}Input: "), F.coalesce(question, F.lit("")), F.lit("\nOutput:"))
    turns = [("system", system.strip()), *(t for e in examples for t in (("user", str(e["input"])), ("assistant", str(e["output"]))))]
    message = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    return F.to_json(F.array(*(message(r, F.lit(c)) for r, c in turns), message("user", F.coalesce(question, F.lit("")))))
