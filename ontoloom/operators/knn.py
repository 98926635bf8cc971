"""Exact nearest neighbours by blocks, phrase vectors, word vectors, and diagnostics of neighbour tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def exact_top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, rows_per_block: int = 16_384, least_blocks: int = 4) -> DataFrame:
    """``id, neighbour, similarity, rank``: the ``k`` vectors of largest cosine for each query, itself aside; ties by id.

    Both frames have id and vec. Queries and vectors are cut into blocks of about ``rows_per_block`` rows; a task multiplies one block of each and keeps k per query, so
    memory is bounded by the block and what is shuffled on is queries * blocks * k rows. Quadratic by nature: for all against all of large tables
    use an index. A zero vector has similarity 0 to all.
    """
    vec = F.col("vec").cast("array<double>").alias("vec")
    nq, nv = (max(m, -(-t.count() // rows_per_block)) for t, m in ((queries, least_blocks), (vectors, 1)))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("id", vec, own(nq).alias("qb"), each(nv).alias("vb"), F.lit(True).alias("asks"))
    v = vectors.select("id", vec, each(nq).alias("qb"), own(nv).alias("vb"), F.lit(False).alias("asks"))

    def multiply(t: pd.DataFrame) -> pd.DataFrame:
        a, b = t[t["asks"]], t[~t["asks"]]
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "neighbour": [], "similarity": []})
        unit = lambda x: (m := np.stack(x["vec"].to_numpy()).astype(float)) / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, n)
        qi, vi, vu = a["id"].to_numpy(), b["id"].to_numpy(), unit(b)
        out = []
        for at in range(0, len(a), 512):
            s = np.round(unit(a.iloc[at : at + 512]) @ vu.T, 9)
            s[qi[at : at + 512, None] == vi[None, :]] = -np.inf
            for i in range(len(s)):
                best = np.lexsort((vi, -s[i]))[:k]
                best = best[np.isfinite(s[i][best])]
                out.append(pd.DataFrame({"id": qi[at + i], "neighbour": vi[best], "similarity": s[i][best]}))
        return pd.concat(out, ignore_index=True)

    part = q.unionByName(v).groupBy("qb", "vb").applyInPandas(multiply, "id long, neighbour long, similarity double")
    return part.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))).where(F.col("rank") <= k)


def ranked(neighbours: DataFrame) -> DataFrame:
    """A neighbour table (term_id, neighbor_term_id, similarity) with each pair once and its ``rank``."""
    n = neighbours.groupBy("term_id", "neighbor_term_id").agg(F.max("similarity").alias("similarity"))
    return n.withColumn("rank", F.row_number().over(W.partitionBy("term_id").orderBy(F.desc("similarity"), "neighbor_term_id")))


def similarity_curve(neighbours: DataFrame, ranks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """``rank, n, mean, least, most`` of the similarity at some ranks."""
    t = ranked(neighbours).where(F.col("rank").isin(*ranks))
    return t.groupBy("rank").agg(F.count("*").alias("n"), F.avg("similarity").alias("mean"), F.min("similarity").alias("least"), F.max("similarity").alias("most"))


def knee(neighbours: DataFrame, near: int = 5, far: int = 10) -> DataFrame:
    """One row: the mean fall of similarity from rank ``near`` to rank ``far`` over the terms that have both."""
    t = ranked(neighbours).where(F.col("rank").isin(near, far)).groupBy("term_id").agg(F.max(F.when(F.col("rank") == near, F.col("similarity"))).alias("a"), F.max(F.when(F.col("rank") == far, F.col("similarity"))).alias("b"))
    return t.where("a is not null and b is not null").agg(F.count("*").alias("n"), F.avg(F.col("a") - F.col("b")).alias("fall"))


def eligible_rate(neighbours: DataFrame, eligible: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """``k, n, rate``: mean share of eligible terms among the k nearest of each eligible term."""
    e = eligible.select("term_id").distinct()
    t = ranked(neighbours).join(e, "term_id", "left_semi").join(e.select(F.col("term_id").alias("neighbor_term_id"), F.lit(1).alias("ok")), "neighbor_term_id", "left")
    each = t.select("term_id", "rank", F.coalesce("ok", F.lit(0)).alias("ok"), F.explode(F.array(*(F.lit(k) for k in ks))).alias("k")).where("rank <= k")
    return each.groupBy("k", "term_id").agg(F.avg("ok").alias("r")).groupBy("k").agg(F.count("*").alias("n"), F.avg("r").alias("rate"))


def sibling_rate(neighbours: DataFrame, seeds: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """``k, n, rate``: mean share of the k nearest that have a parent in common with the term; ``seeds``: term_id, parent."""
    s = seeds.select("term_id", "parent").distinct()
    base = ranked(neighbours).join(s.select("term_id").distinct(), "term_id", "left_semi")
    hit = base.join(s, "term_id").join(s.select(F.col("term_id").alias("neighbor_term_id"), "parent"), ["neighbor_term_id", "parent"]).select("term_id", "neighbor_term_id", F.lit(1).alias("ok")).distinct()
    each = base.join(hit, ["term_id", "neighbor_term_id"], "left").select("term_id", "rank", F.coalesce("ok", F.lit(0)).alias("ok"), F.explode(F.array(*(F.lit(k) for k in ks))).alias("k")).where("rank <= k")
    return each.groupBy("k", "term_id").agg(F.avg("ok").alias("r")).groupBy("k").agg(F.count("*").alias("n"), F.avg("r").alias("rate"))


def coverage(terms: DataFrame, neighbours: DataFrame) -> DataFrame:
    """One row: terms, terms with neighbours, and their share in per cent."""
    has = neighbours.select("term_id").distinct().withColumn("has", F.lit(1))
    return terms.select("term_id").distinct().join(has, "term_id", "left").agg(F.count("*").alias("n_terms"), F.count("has").alias("n_covered"), (100.0 * F.count("has") / F.count("*")).alias("percent"))


def phrase_vectors(terms: DataFrame, words: DataFrame) -> DataFrame:
    """``term_id, vec, n_known, reason``: mean vector of a term's words that have one; reason 'no_vector' where none has. ``words``: word, vec."""
    t = terms.select("term_id", F.explode(F.filter(F.split(F.lower("term"), r"\s+"), lambda x: x != "")).alias("word"))
    each = t.join(words, "word", "left").select("term_id", F.posexplode_outer("vec").alias("i", "x"))
    mean = each.groupBy("term_id", "i").agg(F.avg("x").alias("x"), F.count("x").alias("n"))
    g = mean.groupBy("term_id").agg(F.array_sort(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "x"))))["x"].alias("vec"), F.max("n").alias("n_known"))
    return g.select("term_id", F.when(F.size("vec") > 0, F.col("vec")).alias("vec"), "n_known", F.when(F.size("vec") == 0, "no_vector").alias("reason"))


def train_skipgram(sentences: DataFrame, words: str = "words", dim: int = 100, window: int = 5, min_count: int = 3, partitions: int = 4, seed: int = 42):
    """A skip-gram model (Word2VecModel) of a frame with an array of words per sentence."""
    from pyspark.ml.feature import Word2Vec

    return Word2Vec(vectorSize=dim, windowSize=window, minCount=min_count, numPartitions=partitions, seed=seed, maxIter=1, inputCol=words, outputCol="vec").fit(sentences)


def corpus(tokens: DataFrame) -> DataFrame:
    """``doc_id, sent_idx, words``: the lemmas of each sentence in small letters, empty ones left out."""
    t = tokens.where("tag <> 'PUNCT'").groupBy("doc_id", "sent_idx").agg(F.array_sort(F.collect_list(F.struct("pos", F.lower("lemma").alias("w"))))["w"].alias("words"))
    return t.withColumn("words", F.filter("words", lambda w: w != ""))



def select_terms(terms: DataFrame, min_tf_idf: float = 10.0) -> DataFrame:
    """The terms that are worth a vector: score of at least ``min_tf_idf``; null scores and texts are left out, repeated rows are one."""
    return terms.where((F.col("tf_idf") >= min_tf_idf) & F.col("term_text").isNotNull()).distinct()


def evaluate_k(neighbours: DataFrame | None, seeds: DataFrame | None, eligible: DataFrame | None, ks: tuple[int, ...] = (3, 5, 8, 10), ranks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """``measure, k, n, value``: the choice of k in one table: similarity by rank (mean, least, most), eligible and sibling rate by k.

    Raises ValueError naming the tables that are missing (None).
    """
    missing = [n for n, t in (("neighbours", neighbours), ("seeds", seeds), ("eligible", eligible)) if t is None]
    if missing:
        raise ValueError(f"missing: {', '.join(missing)}")
    curve = similarity_curve(neighbours, ranks).unpivot(["rank", "n"], ["mean", "least", "most"], "measure", "value").select(F.concat(F.lit("similarity_"), "measure").alias("measure"), F.col("rank").alias("k"), "n", "value")
    rates = [r.select(F.lit(m).alias("measure"), "k", "n", F.col("rate").alias("value")) for m, r in (("eligible_rate", eligible_rate(neighbours, eligible, ks)), ("sibling_rate", sibling_rate(neighbours, seeds, ks)))]
    return curve.unionByName(rates[0]).unionByName(rates[1])


def save_model(model, path: str) -> None:
    """Store a skip-gram model; an older one at the path is replaced."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml.feature import Word2VecModel

    return Word2VecModel.load(path)
