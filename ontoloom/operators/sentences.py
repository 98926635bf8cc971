"""Sentence boundaries across languages and scripts, by cascading tables of break and no-break rules."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.functions.sentence_rules import CASCADES, CLOSERS, QUOTATIONS, TABLES, WIDE

#: Blanks of any kind, as Python's ``str.isspace`` has them.
PARAGRAPH = re.compile(r"\n\s*\n")
#: Full stops between digits are no marks.
MARK = re.compile(rf"(?:[!?…{WIDE}]|\.(?!\d))+")
QUOTE = re.compile("|".join(f"{o}[^{o if o not in c else ''}{c}]*[{c}]" for o, c in QUOTATIONS))
LAST_WORD = regex.compile(r"(?r)[^\W_]+")
PLAIN_WORD = regex.compile(r"(?r)(?<!\w)[^\W\d_]{3,}")


class Cascade:
    """The rules of a language by the sign before the position and, for abbreviations, by the word before the full stop; each list in the order of the tables."""

    def __init__(self, language: str):
        rules = [(r, (r.breaks, regex.compile(f"(?r){r.before}").match, re.compile(r.after).match, r.opens)) for t in CASCADES[language] for r in TABLES[t]]
        signs = {c for r, _ in rules for c in r.at} | {""}
        fit = lambda r, c: not r.at or c in r.at
        self.by_sign = {c: [x for r, x in rules if fit(r, c) and not r.words] for c in signs}
        words = {w for r, _ in rules for w in r.words}
        self.by_word = {w: [x for r, x in rules if fit(r, ".") and (not r.words or w in r.words)] for w in words}

    def rules_at(self, text: str, p: int, left: int) -> list:
        c = text[p - 1]
        if c == ".":
            w = LAST_WORD.match(text, left, p - 1)
            if w is not None and (found := self.by_word.get(w.group().lower())):
                return found
        return self.by_sign.get(c, self.by_sign[""])

    def plain(self, text: str, s: int, p: int, left: int) -> bool:
        """A full stop behind a word of three or more small letters that ends no abbreviation, before blanks and a capital: only the last table matches."""
        if p - s != 1 or text[s] != "." or p + 1 >= len(text) or not text[p].isspace() or not text[p + 1].isupper():
            return False
        w = PLAIN_WORD.match(text, left, s)
        return w is not None and (x := w.group()).islower() and x not in self.by_word

    def ends(self, text: str, p: int, left: int) -> bool:
        """Whether the unit that began at ``left`` ends at ``p``, behind a mark: the first rule that matches decides; no rule: it goes on."""
        for breaks, before, after, opens in self.rules_at(text, p, left):
            if after(text, p) and (m := before(text, left, p)) and (not opens or not text[left : m.start()].strip()):
                return breaks
        return False


@lru_cache
def _cascade(language: str) -> Cascade:
    return Cascade(language)


def units(text: str, language: str = "*") -> list[tuple[int, int]]:
    """(start, end) of every sentence unit, trimmed of blanks; positions count characters from 0, the end is exclusive."""
    rules, found, at = _cascade(language), [], 0
    for para in [*PARAGRAPH.finditer(text), None]:
        end = para.start() if para else len(text)
        if at < end:
            piece = text[at:end]
            if piece and not piece.isspace():
                _paragraph(text, at, end, rules, found)
        at = para.end() if para else end
    return found


def _paragraph(text: str, start: int, end: int, rules: Cascade, found: list[tuple[int, int]]) -> None:
    quotes = [q.span() for q in QUOTE.finditer(text, start, end)]
    k, left = 0, start
    for m in MARK.finditer(text, start, end):
        s, p = m.span()
        if s < left:
            continue
        while k < len(quotes) and quotes[k][1] < p:
            k += 1
        if k < len(quotes) and quotes[k][0] < s:  # inside a quotation: only its last mark can end a unit
            q = quotes[k][1]
            if text[p : q - 1].strip():
                continue
            p = q
        while p < end and text[p] in CLOSERS:
            p += 1
        if p >= end or rules.plain(text, s, p, left) or rules.ends(text, p, left):
            _add(text, left, p, found)
            left = p
    _add(text, left, end, found)


def _add(text: str, s: int, e: int, found: list[tuple[int, int]]) -> None:
    while s < e and text[s].isspace():
        s += 1
    while e > s and text[e - 1].isspace():
        e -= 1
    if s < e:
        found.append((s, e))


def segment(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "*") -> DataFrame:
    """``<key>, sent_idx, start_char, end_char, sentence``: the sentence units of every text.

    ``sent_idx`` counts from 0. Null, empty and blank texts have no units; a row with a null key keeps its units under a null
    key; repeated rows are segmented as often as they stand there. Texts of any length are read whole. Other columns of ``docs``,
    also ones named like the result's, are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, idx, starts, ends, sents = [], [], [], [], []
            for k, t in zip(b["k"], b["t"], strict=True):
                for i, (s, e) in enumerate(units(t, language)):
                    keys.append(k), idx.append(i), starts.append(s), ends.append(e), sents.append(t[s:e])
            yield pd.DataFrame({"k": pd.array(keys, dtype=b["k"].dtype), "sent_idx": idx, "start_char": starts, "end_char": ends, "sentence": sents})

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).where("t is not null and t <> ''")
    out = rows.mapInPandas(run, "k string, sent_idx int, start_char int, end_char int, sentence string")
    return out.select(F.col("k").cast(kind).alias(key), "sent_idx", "start_char", "end_char", "sentence")
