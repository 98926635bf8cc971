"""Lengths of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.session import materialise

#: The vocabulary file used unless another is named.
VOCABULARY = os.environ.get("ONTOLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")


@lru_cache
def _encoding(path: str, pattern: str | None):
    import tiktoken

    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), vocabulary: str = VOCABULARY, pattern: str | None = None) -> DataFrame:
    """``id, tokens`` and the columns ``keep``, stored: the token count of each whole text.

    Null and empty texts and null keys have no row; repeated rows of a key are one (its longest text, then the smallest values of ``keep``).
    """
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(vocabulary, pattern)
        for b in batches:
            yield b.drop(columns="text").assign(tokens=[len(enc.encode_ordinary(t)) for t in b["text"]])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), *(F.col(c).cast("string").alias(n) for c, n in zip(keep, names, strict=True)))
    counted = rows.where("id is not null and text <> ''").mapInPandas(run, ", ".join(["id long", *(f"{n} string" for n in names), "tokens long"]))
    one = counted.groupBy("id").agg(F.min(F.struct((-F.col("tokens")).alias("m"), *names)).alias("x"))
    return materialise(one.select("id", (-F.col("x.m")).alias("tokens"), *(F.col(f"x.{n}").alias(c) for n, c in zip(names, keep, strict=True))), "tokens")
