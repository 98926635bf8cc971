"""Mixing sources to target shares of tokens: entropy balancing.

The rates at which documents are used are as near as possible (in relative entropy) to using each once, under the constraints that
each source gives its share of the tokens and that no document is used more often than its source allows. The dual has one number per token constraint, v: a document of n
tokens is used at the rate exp(v * n / mean length of the source), or at the most allowed where that is less. Sources that must give more than they have lean
towards their long documents, the others towards their short ones. Newton's method solves the dual, each iteration being one aggregation of
exponentially tilted moments over all documents (counted by source and length before). Rates are rounded into copies within bounded groups of
documents of a source, the error going on to the next shorter document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoloom.functions.text import squeeze
from ontoloom.llm.tokens import VOCABULARY, token_counts
from ontoloom.session import materialise


def source_key(c: Column) -> Column:
    """The source as compared: lower case, blanks, hyphens and underscores alike."""
    return F.nullif(F.regexp_replace(squeeze(F.lower(c)), r"[\s_\-]+", "_"), F.lit(""))


def solve(moments, want: np.ndarray, have: np.ndarray, most: np.ndarray, rounds: int = 100, tolerance: float = 1e-7) -> np.ndarray:
    """The dual variable of each source, at which rates of least(most, exp(v * x)), x = tokens / mean tokens, give the wanted tokens.

    ``moments(v)`` gives for each source the sums over its documents of rate * x and, where the rate is below the most, of rate * x * x: the token constraint and its
    slope. Newton steps on the logarithm of the tokens are kept within the bounds found so far. Infinite where all documents are needed as often as possible.
    """
    full = want >= have * most * (1 - 1e-12)
    v = np.where(full, np.inf, np.log(np.maximum(want, 1e-300) / have))
    low, high = np.full(len(v), -np.inf), np.full(len(v), np.inf)
    aim = np.log(np.maximum(want, 1e-300))
    for _ in range(rounds if not full.all() else 0):
        m = moments(v)
        gap = np.where(full, 0, np.log(np.maximum(m[:, 0], 1e-300)) - aim)
        if (np.abs(gap) < tolerance).all():
            return v
        high, low = np.where(gap > 0, np.minimum(high, v), high), np.where(gap < 0, np.maximum(low, v), low)
        step = np.where(m[:, 1] > 0, -gap * m[:, 0] / np.maximum(m[:, 1], 1e-300), -np.sign(gap))
        new = v + np.clip(step, -4, 4)
        inside = (new > low) & (new < high)
        both = np.isfinite(low) & np.isfinite(high)
        middle = np.where(both, (np.where(both, low, 0) + np.where(both, high, 0)) / 2, new)
        v = np.where(full, np.inf, np.where(inside, new, middle))
    return v


def _draw(g: pd.DataFrame) -> pd.DataFrame:
    """Round rates up or down, longest documents first, so that the tokens used so far stay as near as possible to what the rates ask for."""
    g = g.sort_values(["tokens", "id"], ascending=[False, True], kind="stable")
    rate, tokens = g["rate"].to_numpy(), g["tokens"].to_numpy()
    copies, owed = np.floor(rate + 1e-9).astype(np.int64), 0.0
    for i, (r, t, c) in enumerate(zip(rate, tokens, copies, strict=True)):
        owed += (r - c) * t
        if r - c > 1e-9 and owed * 2 >= t:
            copies[i] += 1
            owed -= t
    return g.assign(copies=copies)[["id", "source", "tokens", "rate", "copies"]]


def mix(
    docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, key: str = "doc_id", text: str = "text", source: str = "source", group: int = 2000, vocabulary: str = VOCABULARY,
    counts: DataFrame | None = None,
) -> DataFrame:
    """``id, source, tokens, rate, copies``: each document that is used, with its number of copies.

    ``targets`` (source, target_share, max_repeats) is small by nature: at most 10,000 sources. The mixture has ``total_tokens`` tokens, by default
    the most at which every source that exists can give its share without being repeated more than ``max_repeats`` times; with a given
    total, a source gives what it can. Shares of sources without documents are spread over the others. Documents of sources
    without a target, or without a source, and null and empty texts are not used; repeated rows of a key are one document.
    ``group`` is the number of documents among which rates are rounded together.
    """
    spark = targets.sparkSession
    if counts is None:
        counts = token_counts(docs, key, text, keep=(source,), vocabulary=vocabulary)
    want = targets.select(source_key(F.col("source")).alias("source"), F.col("target_share").alias("share"), F.col("max_repeats").alias("most")).where("source is not null and share > 0")
    want = want.groupBy("source").agg(F.max("share").alias("share"), F.max("most").alias("most")).limit(10_001).collect()
    if len(want) > 10_000:
        raise ValueError("more than 10,000 sources")
    table = materialise(counts.select("id", source_key(F.col(source)).alias("source"), "tokens").where("tokens > 0"), "mix")
    lengths = materialise(table.groupBy("source", "tokens").agg(F.count("*").alias("n")), "lengths")
    have = {r["source"]: r for r in lengths.groupBy("source").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("tokens")).alias("t")).collect() if r["source"]} if want else {}
    want = sorted((r["source"], r["share"], r["most"]) for r in want if r["source"] in have)
    kind = "source string, v double, scale double, most int, n long"
    if not want:
        return table.where("false").select("id", "source", "tokens", F.lit(0.0).alias("rate"), F.lit(0).alias("copies"))
    names = [w[0] for w in want]
    share, most = np.array([w[1] for w in want]) / sum(w[1] for w in want), np.array([w[2] for w in want])
    n, t = np.array([have[s]["n"] for s in names], float), np.array([have[s]["t"] for s in names], float)
    total = float(total_tokens) if total_tokens is not None else (most * t / share).min()
    want_t = np.minimum(share * total, most * t)
    scale = t / n
    place = {s: i for i, s in enumerate(names)}

    def rates_at(v: np.ndarray) -> DataFrame:
        rows = [(s, float(np.clip(v[i], -1e300, 1e300)), float(scale[i]), int(most[i]), int(n[i])) for s, i in place.items()]
        return spark.createDataFrame(rows, kind)

    x = F.col("tokens") / F.col("scale")
    rate = F.least(F.col("most").cast("double"), F.exp(F.least(F.lit(50.0), F.col("v") * x)))

    def moments(v: np.ndarray) -> np.ndarray:
        r, out = rate * F.col("n_docs"), np.zeros((len(names), 2))
        free = F.when(rate < F.col("most"), r * x * x).otherwise(0.0)
        tilted = lengths.withColumnRenamed("n", "n_docs").join(F.broadcast(rates_at(v)), "source").groupBy("source")
        for row in tilted.agg(F.sum(r * F.col("tokens")).alias("a"), F.sum(free * F.col("scale")).alias("b")).collect():
            out[place[row["source"]]] = row["a"], row["b"]
        return out

    rates, rate = rates_at(solve(moments, want_t, t, most)), F.round(rate, 9)
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / group))
    rated = table.join(F.broadcast(rates), "source").select("id", "source", "tokens", rate.alias("rate"), part.alias("part"))
    drawn = rated.groupBy("source", "part").applyInPandas(_draw, "id long, source string, tokens long, rate double, copies int")
    return drawn.where("copies > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, max_repeats, n_docs, tokens, actual_share, most_copies`` of every target source."""
    per = mixed.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    total = per.agg(F.sum("tokens")).scalar()
    t = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null").dropDuplicates(["source"])
    zero = lambda c: F.coalesce(c, F.lit(0))
    return t.join(per, "source", "left").select(
        "source", "target_share", "max_repeats", zero("n_docs").alias("n_docs"), zero("tokens").alias("tokens"),
        F.coalesce(F.col("tokens") / total, F.lit(0.0)).alias("actual_share"), zero("most_copies").alias("most_copies"),
    )
