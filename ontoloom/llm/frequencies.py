"""Frequency of every distinct term, and how distinctive a term is for a record.

Vertical layout: a term's records are kept as a compressed bitmap, here one 64-bit word for each stretch of 64 record
numbers in which the term occurs at all, with the occurrences counted beside it. Bitmaps merge by union (bitwise or),
and the document frequency is their cardinality. Occurrences are spread by (term, stretch of records), so
that a term with a third of all rows is shared by many tasks; joins are plain equi-joins whose hot keys Spark's skew handling splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ontoloom.functions.text import label_key
from ontoloom.session import broadcast_if_small, materialise

#: A stretch of records that one task handles together for one term has 2**SPREAD record numbers; a word of a bitmap 2**6.
SPREAD, WORD = 12, 6


class Vocabulary:
    """Lemmas with integer ids, and the term ids that stand for them; both stored tables.

    A lemma is ``label_key`` of the lemma column. Null and blank lemmas and null term ids stand for nothing. A term id given with
    several lemmas counts for each of them; repeated rows count once.
    """

    def __init__(self, candidates: DataFrame, term_id: str = "term_id", lemma: str = "term_lemma"):
        pairs = candidates.select(F.col(term_id).cast("long").alias("term_id"), label_key(F.col(lemma)).alias("lemma")).where("lemma is not null")
        lemmas = pairs.groupBy("lemma").agg(F.count_distinct("term_id").alias("n_term_ids"))
        self.lemmas = materialise(lemmas.withColumn("lemma_id", F.monotonically_increasing_id()), "lemmas")
        self.ids = materialise(pairs.where("term_id is not null").distinct().join(self.lemmas, "lemma").select("term_id", "lemma_id"), "term-ids")


def postings(occurrences: DataFrame, vocabulary: Vocabulary, broadcast_rows: int = 1_000_000) -> DataFrame:
    """``lemma_id, stretch, doc_id, n``: the occurrences of a lemma in a record, each distinct position counted once.

    A position is (sent_idx, token_start, token_end), nulls being values of their own; rows whose term id stands for no lemma and
    rows without a doc_id don't count. The term-id table is broadcast only if it has at most ``broadcast_rows`` rows
    (two numbers each).
    """
    int_min = F.lit(-(2**31))
    first = F.shiftleft(F.coalesce("sent_idx", int_min).cast("long"), 32).bitwiseOR(F.coalesce("token_start", int_min).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    occ = occurrences.select(F.col("term_id").cast("long").alias("term_id"), F.col("doc_id").cast("long").alias("doc_id"), first.alias("first"), F.col("token_end").cast("int").alias("last"))
    occ = occ.where("doc_id is not null and term_id is not null").join(broadcast_if_small(vocabulary.ids, broadcast_rows), "term_id")
    keys = ["lemma_id", "stretch", "doc_id"]
    spread = occ.select("lemma_id", F.shiftright("doc_id", SPREAD).alias("stretch"), "doc_id", "first", "last").repartition("lemma_id", "stretch")
    return spread.groupBy(*keys, "first", "last").agg(F.lit(1).alias("x")).groupBy(*keys).agg(F.count("*").alias("n"))


def bitmaps(posts: DataFrame) -> DataFrame:
    """``lemma_id, word, bits, n``: bitmap words of the records of each lemma, with the occurrences in them."""
    bit = F.expr(f"shiftleft(1L, cast(doc_id & {(1 << WORD) - 1} as int))")
    return posts.groupBy("lemma_id", "stretch", F.shiftright("doc_id", WORD).alias("word")).agg(F.bit_or(bit).alias("bits"), F.sum("n").alias("n"))


def n_records(words: DataFrame) -> DataFrame:
    """One row with the number of records in the union of all bitmaps."""
    return words.groupBy("word").agg(F.bit_or("bits").alias("bits")).agg(F.sum(F.bit_count("bits")).alias("n_records"))


def term_frequencies(occurrences: DataFrame, candidates: DataFrame, min_docs: int = 3, max_share: float = 0.08, broadcast_rows: int = 1_000_000) -> DataFrame:
    """One row for every lemma of ``candidates``: ``term_lemma, n_term_ids, freq_total, freq_docs, too_rare, too_common``.

    ``too_rare``: in fewer than ``min_docs`` records, none included. ``too_common``: in more than ``max_share`` of the records
    that have any counted occurrence. Without occurrences every lemma is too rare; without candidates there are no rows. See
    ``Vocabulary`` and ``postings`` for nulls and repeated rows.
    """
    v = Vocabulary(candidates)
    words = materialise(bitmaps(postings(occurrences, v, broadcast_rows)), "bitmaps")
    total = F.coalesce(n_records(words).scalar(), F.lit(0))
    freq = words.groupBy("lemma_id").agg(F.sum("n").alias("freq_total"), F.sum(F.bit_count("bits")).alias("freq_docs"))
    joined = v.lemmas.join(freq, "lemma_id", "left")
    docs = F.coalesce("freq_docs", F.lit(0))
    return joined.select(
        F.col("lemma").alias("term_lemma"), "n_term_ids", F.coalesce("freq_total", F.lit(0)).alias("freq_total"), docs.alias("freq_docs"),
        (docs < min_docs).alias("too_rare"), (docs > max_share * total).alias("too_common"),
    )


# --- distinctiveness -------------------------------------------------------------------------------------------------

PARAMS = "lemma_id long, freq_docs long, elite_share double, elite_rate double, other_rate double"


def fit_two_poisson(counts: np.ndarray, weights: np.ndarray, term: np.ndarray, n_terms: int, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fit for all terms at once the mixture of two Poisson distributions to their histograms, by expectation-maximisation.

    Entry i says that ``weights[i]`` records have ``counts[i]`` occurrences of term ``term[i]``. Gives elite share, elite rate and
    other rate of each term.
    """
    n = np.bincount(term, weights, n_terms)
    mean = np.bincount(term, weights * counts, n_terms) / np.maximum(n, 1)
    present = np.bincount(term, weights * (counts > 0), n_terms)
    share = np.clip(present / np.maximum(n, 1) * 0.5, 1e-9, 0.5)
    elite, other = np.maximum(np.bincount(term, weights * counts, n_terms) / np.maximum(present, 1) * 1.5, 1e-6), np.maximum(mean * 0.5, 1e-9)
    for _ in range(rounds):
        p = _posterior(counts, share[term], elite[term], other[term])
        we, wo = weights * p, weights * (1 - p)
        se, so = np.bincount(term, we, n_terms), np.bincount(term, wo, n_terms)
        share = np.clip(se / np.maximum(n, 1), 1e-12, 1 - 1e-12)
        elite = np.maximum(np.bincount(term, we * counts, n_terms) / np.maximum(se, 1e-12), 1e-9)
        other = np.maximum(np.bincount(term, wo * counts, n_terms) / np.maximum(so, 1e-12), 1e-12)
    swap = other > elite
    return np.where(swap, 1 - share, share), np.where(swap, other, elite), np.where(swap, elite, other)


def _posterior(k: np.ndarray, share: np.ndarray, elite: np.ndarray, other: np.ndarray) -> np.ndarray:
    z = np.log(1 - share) - np.log(share) + k * (np.log(other) - np.log(elite)) + elite - other
    return 1 / (1 + np.exp(np.clip(z, -700, 700)))


def _fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        if not len(b):
            continue
        size = b["ks"].map(len).to_numpy()
        term = np.repeat(np.arange(len(b)), size)
        k, w = np.concatenate(b["ks"].to_numpy()).astype(float), np.concatenate(b["ws"].to_numpy()).astype(float)
        docs = np.bincount(term, w, len(b))
        without = np.maximum(b["n_records"].to_numpy() - docs, 0)
        share, elite, other = fit_two_poisson(np.concatenate([k, np.zeros(len(b))]), np.concatenate([w, without]), np.concatenate([term, np.arange(len(b))]), len(b))
        yield pd.DataFrame({"lemma_id": b["lemma_id"], "freq_docs": docs.astype("int64"), "elite_share": share, "elite_rate": elite, "other_rate": other})


def distinctiveness(occurrences: DataFrame, candidates: DataFrame, top: int | None = None, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Each lemma of each record with its scores: ``doc_id, term_lemma, n, freq_docs, idf, score, elite_p, rank``.

    ``n`` occurrences in the record; ``idf`` = ln((N+1)/(freq_docs+1)) + 1 over the N records with any counted occurrence; ``score`` = n
    * idf. ``elite_p`` is the probability that the record is one of those which the lemma is about: the posterior of
    the elite component, given n, of a mixture of two Poisson distributions fitted to the lemma's frequency histogram over
    all N records. ``rank`` orders the lemmas of a record by score, ties by lemma in code point order; with ``top`` only
    ranks up to it are given (their rows are picked before the shuffle). Lemmas, nulls and repeated rows as in ``postings``.
    """
    v = Vocabulary(candidates)
    posts = materialise(postings(occurrences, v, broadcast_rows), "postings")
    total = F.coalesce(n_records(bitmaps(posts)).scalar(), F.lit(0))
    histogram = posts.groupBy("lemma_id", "n").agg(F.count("*").alias("w"))
    # A lemma's list has an entry for each different count, of which there can be at most sqrt(2 * occurrences).
    params = histogram.groupBy("lemma_id").agg(F.collect_list("n").alias("ks"), F.collect_list("w").alias("ws")).withColumn("n_records", total).mapInPandas(_fit, PARAMS)
    params = params.join(v.lemmas.select("lemma_id", F.col("lemma").alias("term_lemma")), "lemma_id")
    z = F.log((1 - F.col("elite_share")) / F.col("elite_share")) + F.col("n") * F.log(F.col("other_rate") / F.col("elite_rate")) + F.col("elite_rate") - F.col("other_rate")
    idf = F.log((total + 1) / (F.col("freq_docs") + 1)) + 1
    scored = posts.join(params, "lemma_id").select(
        "doc_id", "term_lemma", "n", "freq_docs", idf.alias("idf"), (F.col("n") * idf).alias("score"), (1 / (1 + F.exp(z))).alias("elite_p")
    )
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("score"), "term_lemma")))
    return ranked if top is None else ranked.where(F.col("rank") <= top)
