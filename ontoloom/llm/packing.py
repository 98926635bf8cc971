"""Filling containers of a fixed number of tokens: cost-balanced packing.

A document of n tokens costs n + n * n / capacity (linear layers plus attention within the document). Documents are taken in descending order and
each goes to the sequence of lowest cost that has room for it, so that sequences of a training step take about the same time.
Items are dealt at random to shards of a bounded number of tokens, which are packed independently.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.llm.tokens import VOCABULARY, token_counts

RESULT = "container long, id long, piece int, first_token long, tokens long"


def assign(tokens: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item; ``tokens`` in descending order, none above ``capacity``.

    Starts with as many containers as the total needs at least; opens another where nothing has room.
    """
    k = max(1, -(-int(tokens.sum()) // capacity))
    room, cost = np.full(k, capacity, np.int64), np.zeros(k)
    out = np.empty(len(tokens), np.int64)
    for i, n in enumerate(tokens):
        fits = room >= n
        if fits.any():
            j = int(np.where(fits, cost, np.inf).argmin())
        else:
            j = len(room)
            room, cost = np.append(room, capacity), np.append(cost, 0.0)
        room[j] -= n
        cost[j] += n + n * n / capacity
        out[i] = j
    return out


def _pack(capacity: int):
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        s = shard.sort_values(["tokens", "id", "piece"], ascending=[False, True, True], kind="stable")
        at = assign(s["tokens"].to_numpy(np.int64), capacity)
        return s.assign(container=s["shard"].to_numpy() * 2**24 + at)[["container", "id", "piece", "first_token", "tokens"]]

    return run


def pack(
    docs: DataFrame, capacity: int = 4096, containers_per_shard: int = 512, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, counts: DataFrame | None = None
) -> DataFrame:
    """``container, id, piece, first_token, tokens``: every document once, in containers of at most ``capacity`` tokens.

    A document is cut only if it alone is longer than ``capacity``: into full pieces and a rest; ``piece`` counts from 0,
    ``first_token`` is where the piece starts. Null and empty texts are in no container; repeated rows of a key are one document; no
    documents give no containers. ``counts`` (id, tokens) saves the counting of tokens where it is known.
    """
    counts = token_counts(docs, key, text, vocabulary=vocabulary) if counts is None else counts
    total = counts.agg(F.sum("tokens")).first()[0] or 0
    shards = max(1, round(total / (capacity * containers_per_shard)))
    pieces = F.posexplode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("tokens") - 1), F.lit(capacity))).alias("piece", "first_token")
    items = counts.where("tokens > 0").select("id", F.col("tokens").alias("whole"), pieces)
    items = items.select("id", "piece", F.col("first_token").cast("long").alias("first_token"), F.least(F.lit(capacity), F.col("whole") - F.col("first_token")).cast("long").alias("tokens"))
    items = items.withColumn("shard", F.pmod(F.xxhash64("id", "piece"), F.lit(shards)))
    return items.groupBy("shard").applyInPandas(_pack(capacity), RESULT)


def fill(packed: DataFrame, capacity: int = 4096) -> DataFrame:
    """One row: containers, items, tokens, the share of the space that is used, and mean and largest cost of a container."""
    per = packed.groupBy("container").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.sum(F.col("tokens") + F.col("tokens") * F.col("tokens") / capacity).alias("cost"))
    return per.agg(
        F.count("*").alias("containers"), F.sum("n").alias("items"), F.sum("t").alias("tokens"), (F.sum("t") / (F.count("*") * capacity)).alias("used"),
        F.max("t").alias("fullest"), F.avg("cost").alias("mean_cost"), F.max("cost").alias("largest_cost"),
    )
