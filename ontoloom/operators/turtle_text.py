"""Turtle as text from a language model: cleaning, blocks, line rules, fragments."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: What fences and chat leave in the text.
FENCE = r"^\s*```.*$"
CHAT = r"(?i)^\s*(here is|here's|sure|note:|explanation|output:|the following|below is).*$"


def sanitise(c: Column, known: tuple[str, ...] = ("owl", "rdf", "rdfs", "xsd", "hpc"), default: str = "hpc") -> Column:
    """Without fences, chat lines and prefix declarations, from the first Turtle line on; unknown prefixes become ``default``; 'a Class' gets its prefix."""
    lines = F.split(c, "\n")
    kept = F.filter(lines, lambda x: ~x.rlike(FENCE) & ~x.rlike(CHAT) & ~x.rlike(r"(?i)^\s*@?(prefix|base)\b"))
    first = F.array_position(F.transform(kept, lambda x: x.rlike(r"^\s*([A-Za-z][\w-]*:\S+|<[^>]+>|_:\w+|\[)")), True)
    body = F.array_join(F.when(first > 0, F.slice(kept, first.cast("int"), F.size(kept))).otherwise(F.array().cast("array<string>")), "\n")
    body = F.regexp_replace(body, rf"(^|[\s,;(\[])(?!(?:{'|'.join(known)}|https?|_):)[A-Za-z][\w-]*:([A-Za-z])", f"$1{default}:$2")
    body = F.regexp_replace(body, r"(\sa\s+)(Class|ObjectProperty|DatatypeProperty)\b", "$1owl:$2")
    return F.trim(F.regexp_replace(F.regexp_replace(body, r";\s*;", ";"), r"\.\s*\.", "."))


def blocks(texts: DataFrame, key: str = "id", column: str = "text") -> DataFrame:
    """``<key>, block_no, block``: the parts of each text between blank lines, prefix lines left out."""
    t = texts.select(key, F.posexplode(F.split(F.trim(column), r"\n\s*\n")).alias("block_no", "block"))
    return t.where(~F.col("block").rlike(r"^\s*@prefix") & (F.trim("block") != ""))


def block_problem(c: Column) -> Column:
    """Why a block is dropped: dash_subject, dash_name, artifact, collection, brackets, literal_predicate; null if it is kept."""
    first = F.regexp_extract(c, r"(?m)^[ \t]*([^#\s].*)$", 1)
    bare = F.regexp_replace(c, r'"(?:[^"\\]|\\.)*"', '""')
    n = lambda ch: F.length(F.regexp_replace(bare, rf"[^\{ch}]", ""))
    return (
        F.when(first.rlike(r"^[A-Za-z][A-Za-z0-9_-]*:-"), "dash_subject").when(bare.rlike(r"(^|\s)[A-Za-z][A-Za-z0-9_-]*:-"), "dash_name").when(c.contains("```") | c.contains("\\x"), "artifact")
        .when(F.lower(c).rlike("owl:(intersectionof|unionof)") & c.rlike(r'\(\s+[A-Za-z0-9_]+:[A-Za-z0-9_]+\s+"'), "collection").when(n("[") != n("]"), "brackets")
        .when(c.rlike(r'(^|\n)\s*"(?:[^"\\]|\\.)*"(?:\^\^\S+)?\s+[^\s.;,]'), "literal_predicate")
    )


def line_rule(c: Column) -> Column:
    """What happens to a line: rewrite_domain, rewrite_range, drop_number, drop_empty_object, drop_prose, keep."""
    s = F.trim(c)
    return (
        F.when(s.rlike(r"^rdfs:domain\([^)]+\)\s+\S+\s*\.$"), "rewrite_domain").when(s.rlike(r"^rdfs:range\([^)]+\)\s+\S+\s*\.$"), "rewrite_range").when(s.rlike(r"^-?[0-9]+(\.[0-9]+)?\s+\S"), "drop_number")
        .when(s.rlike(r"^[A-Za-z][A-Za-z0-9_-]*:[A-Za-z0-9_-]+\s*[;.]$"), "drop_empty_object").when((s != "") & ~s.startswith("#") & ~s.rlike(r'[:<>"\[\].;]'), "drop_prose").otherwise("keep")
    )


def rewrite_line(c: Column) -> Column:
    """The line with 'rdfs:domain(x) y .' turned into 'x rdfs:domain y .'."""
    return F.regexp_replace(F.trim(c), r"^(rdfs:(?:domain|range))\(\s*([^)]+?)\s*\)\s+(\S+)\s*\.$", "$2 $1 $3 .")


def fix_endings(lines: DataFrame, by: list[str], order: str = "pos", column: str = "line") -> DataFrame:
    """``lines`` with ``fixed``: a line that ends in ';' before a new subject (at the line's start) or the end gets '.'; one that ends in '.' before an indented predicate gets ';'."""
    s = F.regexp_replace(F.col(column), r"\s+$", "")
    real = (F.trim(s) != "") & ~F.trim(s).startswith("#")
    nxt = F.first(F.when(real, s), ignorenulls=True).over(W.partitionBy(*by).orderBy(order).rowsBetween(1, W.unboundedFollowing))
    subject = nxt.isNull() | nxt.rlike(r"^\S")
    return lines.withColumn("fixed", F.when(real & s.endswith(";") & subject, F.regexp_replace(s, r"\s*;$", " .")).when(real & s.endswith(".") & nxt.rlike(r"^\s+\S"), F.regexp_replace(s, r"\s*\.$", " ;")).otherwise(s))


def fragment_id(c: Column) -> Column:
    """A name that is safe as a file name."""
    return F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_")


def shard(df: DataFrame, n: int, k: int, order: str) -> DataFrame:
    """The rows of shard ``k`` of ``n``, dealt by the number in ``order``."""
    return df.where(F.pmod(F.col(order), F.lit(n)) == k)


def merge_fragments(fragments: DataFrame, header: str, key: str = "id", column: str = "text") -> DataFrame:
    """``part, text``: the header, then the fragments that aren't empty, in order of their names; sort by part to write one file."""
    t = fragments.where(F.trim(column) != "").select(F.col(key).alias("part"), F.trim(column).alias("text"))
    return fragments.sparkSession.createDataFrame([("", header)], "part string, text string").unionByName(t).orderBy("part")


def dots_in_brackets(text: str) -> str:
    """Full stops that end a line inside square brackets become semicolons."""
    out, depth = [], 0
    for line in text.split("\n"):
        bare = re.sub(r'"(?:[^"\\]|\\.)*"|<[^>]*>|#.*', "", line)
        after = depth + bare.count("[") - bare.count("]")
        out.append(re.sub(r"\s*\.\s*$", " ;", line) if after > 0 and bare.rstrip().endswith(".") else line)
        depth = max(0, after)
    return "\n".join(out)


def canonical_name(name: str, kind: str) -> str:
    """A local name as class (CamelCase) or as property (lowerCamel); inner capitals of one-word names stay."""
    parts = [p for p in re.split(r"[_\-\s]+", name) if p]
    if not parts:
        return name
    camel = "".join(p[:1].upper() + (p[1:] if len(parts) == 1 else p[1:].lower()) for p in parts)
    return camel if kind == "class" else camel[:1].lower() + camel[1:]


def canonical_names(text: str, prefix: str = "hpc") -> str:
    """Names of the prefix in the text: classes behind a, subClassOf, domain and range and where declared so; other names of a line's predicate as properties."""
    local = rf"{prefix}:([A-Za-z][\w-]*)"
    as_ = lambda kind: lambda m: f"{m.group(1)}{prefix}:{canonical_name(m.group(2), kind)}"
    out = []
    for line in text.split("\n"):
        kind = "property" if re.search(r"owl:(Object|Datatype)Property|rdfs:(domain|range)", line) else "class"
        line = re.sub(rf"^(\S+\s+){local}(?=\s)", as_("property"), line)  # the predicate behind a subject
        line = re.sub(rf"^(\s*){local}", as_(kind if not line[:1].isspace() else "property"), line)
        line = re.sub(rf"((?:rdfs:subClassOf|rdfs:domain|rdfs:range|\sa)\s+){local}", as_("class"), line)
        out.append(line)
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def dots_in_brackets_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else dots_in_brackets(t))


@F.pandas_udf(T.StringType())
def canonical_names_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else canonical_names(t))


@F.pandas_udf(T.StringType())
def turtle_error_udf(s: pd.Series) -> pd.Series:
    """What is wrong with a fragment, null if it can be read."""
    from ontoloom.operators.rdf import TurtleError, parse_turtle

    def check(t: str | None) -> str | None:
        try:
            parse_turtle(t or "")
            return None
        except TurtleError as e:
            return str(e)

    return s.map(check)


def salvage(texts: DataFrame, prefixes: str, key: str = "id", column: str = "text") -> DataFrame:
    """``<key>, block_no, block, problem``: blocks with why they are dropped, by rule or because they can't be read; null where kept."""
    b = blocks(texts, key, column).withColumn("block", dots_in_brackets_udf("block"))
    return b.withColumn("problem", F.coalesce(block_problem(F.col("block")), turtle_error_udf(F.concat(F.lit(prefixes), F.col("block")))))


def mend(salvaged: DataFrame, prefixes: str) -> DataFrame:
    """``salvaged`` with ``block`` and ``problem`` mended: of blocks without a rule against them that can't be read, the faulty lines go (``dropped_lines``)."""
    rule = block_problem(F.col("block"))
    m = F.when(rule.isNull() & F.col("problem").isNotNull(), salvage_lines_udf(F.lit(prefixes), F.col("block")))
    t = salvaged.withColumn("m", m)
    fixed = F.coalesce(F.col("m.text") != "", F.lit(False))
    block, problem = F.when(fixed, F.col("m.text")).otherwise(F.col("block")), F.when(fixed, None).otherwise(F.col("problem"))
    return t.withColumn("dropped_lines", F.when(fixed, F.col("m.dropped")).otherwise(0)).withColumn("problem", problem).withColumn("block", block).drop("m")


def drop_counts(salvaged: DataFrame) -> DataFrame:
    """``problem, n`` of the blocks, 'kept' for those without one."""
    return salvaged.groupBy(F.coalesce("problem", F.lit("kept")).alias("problem")).agg(F.count("*").alias("n"))


def line_counts(lines: DataFrame, column: str = "line") -> DataFrame:
    """``rule, n``: how many lines each rule of ``line_rule`` applies to."""
    return lines.groupBy(line_rule(F.col(column)).alias("rule")).agg(F.count("*").alias("n"))


def salvage_lines(text: str, prefixes: str = "", most: int = 50) -> tuple[str, int]:
    """The block without the lines that keep it from being read, and their number; empty if more than ``most`` would have to go.

    Each time the block can't be read, the last line of the shortest beginning that can't be completed goes: that is found by reading the beginnings closed by a full stop.
    """
    from ontoloom.operators.rdf import TurtleError, parse_turtle

    def reads(t: str) -> bool:
        try:
            parse_turtle(prefixes + t)
            return True
        except TurtleError:
            return False

    lines, gone = [x for x in text.split("\n") if x.strip()], 0
    while lines and not reads("\n".join(lines)):
        if gone == most:
            return "", gone + len(lines)
        closed = lambda n: re.sub(r"[\s;,.]*$", " .", "\n".join(lines[:n]), count=1)  # noqa: E731, B023
        bad = next((n for n in range(1, len(lines) + 1) if not reads(closed(n))), None)
        if bad is None:  # only the end is missing
            return closed(len(lines)), gone
        del lines[bad - 1]
        gone += 1
    return "\n".join(lines), gone


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("dropped", T.IntegerType())]))
def salvage_lines_udf(prefixes: pd.Series, blocks: pd.Series) -> pd.DataFrame:
    rows = [salvage_lines(b, p or "") if b is not None else (None, 0) for p, b in zip(prefixes, blocks, strict=True)]
    return pd.DataFrame(rows, columns=["text", "dropped"])


def repair(fragments: DataFrame, factory, prefixes: str = "", attempts: int = 2, key: str = "id", column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(``<key>, text`` of the fragments that can be read, ``<key>, text, error`` of the quarantined ones).

    A fragment that can't be read is given to the model with what is wrong, up to ``attempts`` times; each answer is cleaned and read again.
    """
    from ontoloom.operators.labelling import with_retries
    from ontoloom.operators.rdf import TurtleError, parse_turtle
    from ontoloom.session import materialise

    def fault(answer: str | None) -> str | None:
        try:
            return None if (answer or "").strip() and parse_turtle(prefixes + answer) else "no triples"
        except TurtleError as e:
            return str(e)

    t = fragments.select(F.col(key).alias("id"), F.col(column).alias("text")).withColumn("error", turtle_error_udf(F.concat(F.lit(prefixes), F.coalesce("text", F.lit("")))))
    t = t.withColumn("error", F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "no triples").otherwise(F.col("error")))
    prompt = F.concat(F.lit("This Turtle can't be read: "), "error", F.lit("\nGive the corrected Turtle only.\n"), F.coalesce("text", F.lit("")))
    asked = t.where("error is not null").select("id", prompt.alias("prompt"))
    tried = materialise(with_retries(asked, "prompt", factory, fault, attempts), "repaired")
    good = t.where("error is null").select("id", "text").unionByName(tried.where("error is null").select("id", F.col("answer").alias("text")))
    return good.withColumnRenamed("id", key), tried.where("error is not null").select(F.col("id").alias(key), F.col("answer").alias("text"), "error")
