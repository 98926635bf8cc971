"""Column expressions on text; JVM functions only, but for the Unicode normal form, which Spark has no function for."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of any kind, no-break spaces included (fixed values), as the inside of a character class that
#: Java's regular expressions and RE2 read alike.
BLANK_CLASS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
BLANKS = f"[{BLANK_CLASS}]+"


def last(c: Column | str) -> Column:
    """The last element of an array, null if there is none."""
    return F.try_element_at(c, F.lit(-1))


def squeeze(c: Column) -> Column:
    """Trim blanks and make each run of blanks one space."""
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def label_key(c: Column) -> Column:
    """The label as compared: lower case, trimmed, runs of blanks made one space; null if null or blank."""
    return F.nullif(squeeze(F.lower(c)), F.lit(""))


def label_key_sql(c: str) -> str:
    """``label_key`` as DuckDB SQL."""
    return f"nullif(trim(regexp_replace(lower({c}), '{BLANKS}', ' ', 'g')), '')"


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """The text in Unicode normal form NFKC; ASCII texts stay as they are."""
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))
