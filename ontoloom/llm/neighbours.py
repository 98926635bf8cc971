"""Most similar vectors for every vector: multiprobe p-stable hashing, exact reranking.

Vectors are scaled to length 1 and hashed by floor((a.v + b) / w) with M normal projections in each of L tables; a vector is filed
in its own bucket of each table and looks besides into T perturbed buckets, taken in order of their estimated success (sum of the
squared distances to the crossed boundaries). Only a key and a 256-bit sign sketch travel to the buckets; pairs whose
sketches are close enough become candidates, are merged over the tables and get their exact cosine from the vectors. The nearest of a vector's nearest are compared
with it as well, which finds most pairs that all tables miss.

The parameters come from a ladder of settings that all find at least 99 % of the pairs at the least similarity asked for (and more above it); the
number of vectors only chooses among them what is cheapest, since more tables and narrower buckets mean more rows but fewer comparisons. Both
probabilities depend on distances alone, not on the collection.

No bucket is capped: one with more than ``block`` vectors is cut into blocks by hash of the id, and everything that looks into it is sent
to each block. Exact copies of a vector are searched once and expanded afterwards. A vector with more than ``dense`` similar sketches in one block
is searched exactly, against all vectors in blocks, instead of giving out all these pairs, so that candidates grow in line with the vectors.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ontoloom.session import broadcast_if_small, materialise

SKETCH = 256
#: Settings (functions, tables, probes, width as a multiple of the distance asked for), cheapest rows first, with the share of the pairs at that distance which they find
#: and the share of all vectors that a vector is compared with where most are at right angles and the least cosine is 0.8: both by simulation.
LADDER = (
    (6, 3, 9, 3.2, 0.992, 0.26),
    (7, 4, 10, 3.2, 0.993, 0.20),
    (9, 6, 15, 3.2, 0.994, 0.10),
    (9, 8, 24, 2.6, 0.995, 0.055),
    (10, 10, 30, 2.6, 0.995, 0.038),
    (11, 16, 40, 2.4, 0.995, 0.017),
    (12, 20, 50, 2.4, 0.995, 0.0094),
)
#: What one row of the index costs, in comparisons of sketches (shuffling and sorting against four machine words).
ROW_COST = 1000


@lru_cache
def perturbations(functions: int, n: int) -> tuple[tuple[int, ...], ...]:
    """The ``n`` sets of boundaries, numbered from the nearest to a vector, that are nearest by expectation; no set crosses both boundaries of a function."""
    m = functions
    mean = [j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    mean += [1 - j / (m + 1) + j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(m, 0, -1)]
    near = range(min(2 * m, 14))
    sets = (x for r in range(1, 5) for x in itertools.combinations(near, r) if all(i + j != 2 * m - 1 for i, j in itertools.combinations(x, 2)))
    return tuple(sorted(sets, key=lambda x: (sum(mean[i] for i in x), x))[:n])


@dataclass(frozen=True)
class Hashing:
    """Parameters of the index; ``planned`` takes the rung of the ladder that is cheapest for so many vectors."""

    dim: int
    functions: int = 6
    tables: int = 3
    probes: int = 9
    width: float = 2.02
    seed: int = 7

    @staticmethod
    def planned(dim: int, n: int, min_similarity: float = 0.8) -> Hashing:
        cost = lambda r: r[1] * (1 + r[2]) * ROW_COST + n * r[5]
        m, tables, probes, width, _, _ = min(LADDER, key=cost)
        return Hashing(dim, m, tables, probes, width * math.sqrt(max(2 - 2 * min_similarity, 1e-6)))

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        r = np.random.default_rng(self.seed)
        n = self.tables * self.functions
        a = r.standard_normal((self.dim, n)).astype(np.float32)
        b = r.uniform(0, self.width, n).astype(np.float32)
        mult = r.integers(1, 2**62, n, dtype=np.int64) * 2 + 1
        return a, b, mult, r.standard_normal((self.dim, SKETCH)).astype(np.float32)


def _unit(vectors: pd.Series) -> np.ndarray:
    v = np.stack(vectors.to_numpy()).astype(np.float32)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def buckets_of(v: np.ndarray, h: Hashing, arrays: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the own bucket (n, L) and of the probed buckets (n, L, T) of unit vectors."""
    a, b, mult, _ = arrays
    f = (v @ a + b) / np.float32(h.width)
    whole = np.floor(f).astype(np.int64)
    part = f - whole
    own, probed = [], []
    m, sets = h.functions, perturbations(h.functions, 2 * h.probes)
    for t in range(h.tables):
        cut = slice(t * m, (t + 1) * m)
        w, home = mult[cut], (whole[:, cut] * mult[cut]).sum(1) + np.int64(t)
        gap = np.concatenate([part[:, cut], 1 - part[:, cut]], 1) ** 2
        order = np.argsort(gap, 1)[:, :14]
        near = np.take_along_axis(gap, order, 1)
        which = order % m
        step = np.where(order < m, -1, 1) * w[which]
        score = np.stack([sum(near[:, i] for i in x) for x in sets], 1)
        for j, x in enumerate(sets):
            for i, k in itertools.combinations(x, 2):
                score[which[:, i] == which[:, k], j] = np.inf
        key = np.stack([home + sum(step[:, i] for i in x) for x in sets], 1)
        best = np.argsort(score, 1)[:, : h.probes]
        own.append(home)
        probed.append(np.take_along_axis(key, best, 1))
    return np.stack(own, 1), np.stack(probed, 1)


def _file(h: Hashing, homes_only: bool):
    """Rows (bucket, id, own or probed, sketch) of each vector; with ``homes_only`` just the own buckets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        arrays = h.arrays()
        for b in batches:
            for at in range(0, len(b), 4000):
                part = b.iloc[at : at + 4000]
                v = _unit(part["vec"])
                own, probed = buckets_of(v, h, arrays)
                if homes_only:
                    yield pd.DataFrame({"bucket": own.ravel()})
                    continue
                sketch = np.packbits(v @ arrays[3] > 0, axis=1).view(np.int64)
                keys = np.concatenate([own, probed.reshape(len(v), -1)], 1)
                width = keys.shape[1]
                mark = np.zeros(width, bool)
                mark[: own.shape[1]] = True
                out = {"bucket": keys.ravel(), "id": np.repeat(part["id"].to_numpy(np.int64), width), "own": np.tile(mark, len(v))}
                yield pd.DataFrame(out | {f"s{i}": np.repeat(sketch[:, i], width) for i in range(SKETCH // 64)})

    return run


def _compare(most: int, dense: int, at_once: int = 256, held: int = 2_000_000):
    """Pairs of a row and a filed vector of the same bucket and block whose sketches differ in at most ``most`` bits; rows (a, null) tell that a is dense.

    A pair is left out only if both its vectors have more than ``dense`` such pairs in the block, which makes them dense. Rows
    come sorted by bucket and block; only one bucket's block is held at a time, and of its pairs ``held``: of more, each one's pairs are counted first.
    """
    names = [f"s{i}" for i in range(SKETCH // 64)]

    def close(sk: np.ndarray, ids: np.ndarray, x: np.ndarray, xi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(ids), at_once):
            q = sk[at : at + at_once]
            d = np.bitwise_count(q[:, 0, None] ^ x[None, :, 0]).astype(np.uint16)
            for i in range(1, q.shape[1]):
                d += np.bitwise_count(q[:, i, None] ^ x[None, :, i])
            i, j = np.nonzero(d <= most)
            keep = ids[at + i] != xi[j]
            yield at + i[keep], j[keep]

    def pairs(ids: np.ndarray, is_filed: np.ndarray, sk: np.ndarray, out: list, busy: list) -> None:
        filed = np.flatnonzero(is_filed)
        if not len(filed) or len(ids) < 2:
            return
        x, xi = sk[filed], ids[filed]
        rows, cols, kept, n = np.zeros(len(ids), np.int64), np.zeros(len(xi), np.int64), [], 0
        for i, j in close(sk, ids, x, xi):
            rows += np.bincount(i, minlength=len(ids))
            cols += np.bincount(j, minlength=len(xi))
            n += len(i)
            if n <= held:
                kept.append((i, j))
        many, much = rows > dense, cols > dense
        for i, j in kept if n <= held else close(sk, ids, x, xi):
            keep = ~(many[i] & much[j])
            a, b = ids[i[keep]], xi[j[keep]]
            out.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
        busy += [ids[many], xi[much]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for b in itertools.chain(batches, [None]):
            if b is not None and not len(b):
                continue
            if b is not None and rest and (b[["bucket", "block"]].iloc[-1] == rest[-1][["bucket", "block"]].iloc[0]).all():
                rest.append(b)  # the same block goes on: joined once, at its end
                continue
            whole = [*rest, b] if b is not None else rest
            if not whole:
                return
            t = pd.concat(whole, ignore_index=True)
            key = t[["bucket", "block"]].to_numpy(np.int64)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            ends = [*cuts, len(t)] if b is None else list(cuts)
            ids, filed, sk, out, at = t["id"].to_numpy(np.int64), t["filed"].to_numpy(bool), t[names].to_numpy(np.int64).view(np.uint64), [], 0
            busy: list[np.ndarray] = []
            for e in ends:
                pairs(ids[at:e], filed[at:e], sk[at:e], out, busy)
                at = e
            rest = [t.iloc[at:]] if b is not None else []
            if out:
                p = np.unique(np.concatenate(out), axis=0)
                for at in range(0, len(p), 100_000):
                    yield pd.DataFrame({"a": p[at : at + 100_000, 0], "b": pd.array(p[at : at + 100_000, 1], dtype="Int64")})
                q = np.unique(np.concatenate(busy))
                if len(q):
                    yield pd.DataFrame({"a": q, "b": pd.array([None] * len(q), dtype="Int64")})

    return run


def _good(vectors: DataFrame, key: str, vec: str, dim: int) -> DataFrame:
    good = vectors.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<float>").alias("vec"))
    return good.where(f"id is not null and size(vec) = {dim} and not exists(vec, x -> x is null or isnan(x)) and exists(vec, x -> x <> 0)")


def _best(k: int, at_once: int = 128):
    """Of each asking vector of a task its ``k`` best of the task's vectors; float32 products only choose what is compared in float64."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        asks = t["asks"].to_numpy(bool)
        ids, vecs = t["id"].to_numpy(np.int64), np.stack(t["vec"].to_numpy()).astype(np.float32)
        by_id = np.argsort(ids[~asks])
        qi, q, vi, v = ids[asks], vecs[asks], ids[~asks][by_id], vecs[~asks][by_id]
        out = []
        if len(qi) and len(vi):
            unit = lambda m: (d := m.astype(np.float64)) / np.linalg.norm(d, axis=1, keepdims=True)
            v32, most = unit(v).astype(np.float32), min(k + 1, len(vi))
            for at in range(0, len(qi), at_once):
                u = unit(q[at : at + at_once])
                s = u.astype(np.float32) @ v32.T
                # the vector itself may be one of the k + 1; rounding of the products and of the result is far below the margin
                least = np.partition(s, len(vi) - most, axis=1)[:, len(vi) - most] - np.float32(2e-5)
                for i in range(len(u)):
                    j = np.flatnonzero(s[i] >= least[i])
                    j = j[vi[j] != qi[at + i]]
                    x = np.round(unit(v[j]) @ u[i], 6)
                    best = np.lexsort((vi[j], -x))[:k]
                    out.append((np.full(len(best), qi[at + i]), vi[j][best], x[best]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.array([], t) for t in (np.int64, np.int64, float)]
        return pd.DataFrame({"id": cols[0], "neighbour": cols[1], "similarity": cols[2]})

    return run


def exact_nearest(
    vectors: DataFrame, k: int = 10, key: str = "term_id", vec: str = "vec", dim: int = 100, queries_per_task: int = 16_384, vectors_per_task: int = 65_536,
    queries: DataFrame | None = None, min_similarity: float | None = None,
) -> DataFrame:
    """``id, neighbour, similarity, rank``: of each vector its ``k`` most similar others; the same vectors count as in ``nearest``.

    Only vectors whose id is in ``queries`` (id) ask, if it is given, and only neighbours of cosine ``min_similarity`` or more count, if that is given. Every pair of an
    asking vector and a vector is compared, in blocks, so that nothing is missed; the block sizes bound a task's memory.
    """
    store = materialise(_good(vectors, key, vec, dim).groupBy("id").agg(F.min("vec").alias("vec")), "vectors")
    asking = store if queries is None else materialise(store.join(queries.select("id").distinct(), "id", "left_semi"), "asking")
    nq, nv = max(6, -(-asking.count() // queries_per_task)), max(1, -(-store.count() // vectors_per_task))
    part = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    q = asking.select("id", "vec", F.lit(True).alias("asks"), part(nq).alias("qb"), each(nv).alias("vb"))
    v = store.select("id", "vec", F.lit(False).alias("asks"), each(nq).alias("qb"), part(nv).alias("vb"))
    found = q.unionByName(v).groupBy("qb", "vb").applyInPandas(_best(k), "id long, neighbour long, similarity double")
    if min_similarity is not None:
        found = found.where(F.col("similarity") >= min_similarity)
    return found.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))).where(F.col("rank") <= k)


def nearest(
    vectors: DataFrame, k: int = 10, min_similarity: float = 0.8, key: str = "term_id", vec: str = "vec", dim: int = 100, block: int = 8192, hashing: Hashing | None = None,
    slack: float = 3.5, dense: int = 128,
) -> DataFrame:
    """``id, neighbour, similarity, rank``: of each vector its up to ``k`` most similar others with cosine ``min_similarity`` or more.

    Null vectors, such of another length than ``dim``, with nulls or NaN, and all-zero ones are left out, as are null ids; repeated
    rows are one; of an id with several vectors the smallest in array order is taken. Equal similarities are ranked by id.
    Approximate in that a pair may be missed by all tables (see ``LADDER``) or by its sketches: a pair is a candidate if these differ in
    no more bits than expected at ``min_similarity`` plus ``slack`` standard deviations. Every similarity given is exact (to 6 digits).
    Vectors with more than ``dense`` similar sketches in a block are searched by ``exact_nearest``. ``exact_nearest`` alone is the exact way.
    """
    good = _good(vectors, key, vec, dim)
    h = hashing or Hashing.planned(dim, vectors.count(), min_similarity)
    # exact copies, found by two hashes of the vector: nearly always few
    ids = good.select("id", F.xxhash64("vec").alias("h1"), F.hash("vec").alias("h2")).distinct()
    twice = ids.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    copies = materialise(ids.join(twice, ["h1", "h2"]).select("id", "rep"), "copies")
    single = good.join(broadcast_if_small(copies.where("id <> rep").select("id"), 100_000), "id", "left_anti")

    homes = single.mapInPandas(_file(h, True), "bucket long")
    large = materialise(homes.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > block).select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "large")
    sketch = ", ".join(f"s{i} long" for i in range(SKETCH // 64))
    rows = single.mapInPandas(_file(h, False), f"bucket long, id long, own boolean, {sketch}").join(broadcast_if_small(large, 100_000), "bucket", "left")
    # Each row looks into every block of its bucket; one with its own bucket is filed in one of them.
    blocks = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    rows = rows.select("bucket", "id", "own", *(f"s{i}" for i in range(SKETCH // 64)), F.coalesce("blocks", F.lit(1)).alias("of"), blocks.alias("block"))
    rows = rows.withColumn("filed", F.col("own") & (F.pmod(F.xxhash64("id"), F.col("of")) == F.col("block"))).drop("own", "of")
    frac = math.acos(min_similarity) / math.pi
    most = math.ceil(SKETCH * frac + slack * math.sqrt(SKETCH * frac * (1 - frac)))
    found = materialise(rows.repartition("bucket", "block").sortWithinPartitions("bucket", "block").mapInPandas(_compare(most, dense), "a long, b long"), "candidates")
    candidates, busy = found.where("b is not null").distinct(), found.where("b is null").select(F.col("a").alias("id")).distinct()

    store = single.groupBy("id").agg(F.min("vec").alias("vec"))
    va, vb = (store.select(F.col("id").alias(c), F.col("vec").alias(f"v{c}")) for c in "ab")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    cosine = F.round(dot(F.col("va"), F.col("vb")) / F.sqrt(dot(F.col("va"), F.col("va")) * dot(F.col("vb"), F.col("vb"))), 6)
    measured = lambda p: p.join(va, "a").join(vb, "b").select("a", "b", cosine.alias("similarity")).where(F.col("similarity") >= min_similarity)
    turned = lambda p: p.select(F.explode(F.array(F.struct(F.col("a").alias("q"), F.col("b").alias("x")), F.struct(F.col("b").alias("q"), F.col("a").alias("x")))).alias("p"), "similarity").select("p.q", "p.x", "similarity")
    exact = materialise(measured(candidates), "pairs")
    # what all tables missed is mostly near a common neighbour: of each vector the nearest of its nearest are compared too, at most k * k
    first = turned(exact).withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("similarity"), "x"))).where(F.col("r") <= k).select("q", "x")
    second = first.join(first.select(F.col("q").alias("x"), F.col("x").alias("y")), "x").where("q <> y").select(F.least("q", "y").alias("a"), F.greatest("q", "y").alias("b"))
    exact = exact.unionByName(measured(second.distinct().join(exact.select("a", "b"), ["a", "b"], "left_anti")))
    both = turned(exact)
    if not busy.isEmpty():
        sure = exact_nearest(single, k, "id", "vec", dim, queries=busy, min_similarity=min_similarity)
        both = both.unionByName(sure.select(F.col("id").alias("q"), F.col("neighbour").alias("x"), "similarity")).distinct()
    top = lambda t, by: t.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc("similarity"), "neighbour"))).where(F.col("rank") <= k)
    # copies: a class lends at most its k+1 smallest ids to any neighbour list
    lent = copies.withColumn("r", F.row_number().over(W.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1).select(F.col("rep").alias("x"), "id")
    others = both.join(broadcast_if_small(lent, 100_000), "x", "left").select("q", F.coalesce("id", "x").alias("neighbour"), "similarity")
    others = top(others, "q").drop("rank").join(broadcast_if_small(copies.select(F.col("rep").alias("q"), F.col("id").alias("member")), 100_000), "q", "left")
    others = others.select(F.coalesce("member", "q").alias("id"), "neighbour", "similarity")
    own = copies.join(lent.select(F.col("x").alias("rep"), F.col("id").alias("neighbour")), "rep").where("id <> neighbour").select("id", "neighbour", F.lit(1.0).alias("similarity"))
    return top(others.unionByName(own), "id")


def pairs(near: DataFrame) -> DataFrame:
    """``a, b, similarity``: each pair of which one is among the other's nearest, a < b."""
    return near.select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b"), "similarity").distinct()
