"""Nearest vectors against brute force: recall, copies, hot buckets, odd rows."""

import numpy as np
import pandas as pd
import pytest

from ontoloom.llm import neighbours as nb


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], "z", 1) for i, v in rows], "term_id long, vec array<float>, id string, bucket int")


def clusters(n=400, dim=100, size=6, noise=0.35, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((n, dim))
    c = np.repeat(c, size, 0) + noise * rng.standard_normal((n * size, dim))
    return c * rng.uniform(0.5, 3, (len(c), 1))


def brute(rows, k=10, t=0.8):
    ids = np.array([i for i, _ in rows])
    v = np.array([np.float32(x) for _, x in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(v @ v.T, 6)
    out = set()
    for a in range(len(ids)):
        o = [b for b in np.lexsort((ids, -s[a])) if b != a and s[a, b] >= t][:k]
        out |= {(min(ids[a], ids[b]), max(ids[a], ids[b])) for b in o}
    return out


def test_recall(spark):
    rows = [(i * 3, v) for i, v in enumerate(clusters())]
    got = {(r.a, r.b) for r in nb.pairs(nb.nearest(frame(spark, rows))).collect()}
    want = brute(rows)
    assert got <= want and len(got) >= 0.97 * len(want)


def pairs_at(cos, n, dim=100, seed=1):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((n, dim))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a.astype(np.float32), (cos * a + np.sqrt(1 - cos * cos) * b).astype(np.float32)


@pytest.mark.parametrize("n", [10**4, 10**5, 10**6, 10**7, 10**8, 10**9])
@pytest.mark.parametrize("least", [0.8, 0.6])
def test_planned_recall(n, least):
    h = nb.Hashing.planned(100, n, least)
    arrays = h.arrays()
    for cos, want in ((least, 0.98), ((1 + least) / 2, 0.998)):
        (oa, pa), (ob, pb) = (nb.buckets_of(v, h, arrays) for v in pairs_at(cos, 1500, seed=3))
        assert ((oa == ob) | (pa == ob[:, :, None]).any(2) | (pb == oa[:, :, None]).any(2)).any(1).mean() >= want


def test_dense_vectors_are_searched_exactly(spark):
    rows = [(i, v) for i, v in enumerate(clusters(n=20, size=30, noise=0.25))] + [(1000 + i, v) for i, v in enumerate(clusters(n=40, seed=4))]
    few = nb.nearest(frame(spark, rows), dense=8)
    got, want = {(r.a, r.b) for r in nb.pairs(few).collect()}, brute(rows)
    assert got <= want and len(got) >= 0.97 * len(want)
    per = dict(few.groupBy("id").count().collect())
    assert max(per.values()) == 10


def test_pairs_of_a_block_are_kept_or_dense():
    rng = np.random.default_rng(1)
    sk = rng.integers(0, 2, (300, 256)).astype(np.uint8)
    sk[:100] = sk[0] ^ (rng.random((100, 256)) < 0.02)
    sk = np.packbits(sk, 1).view(np.int64)
    t = pd.DataFrame({"bucket": 5, "block": 0, "id": np.arange(300), "filed": np.arange(300) % 3 > 0, **{f"s{i}": sk[:, i] for i in range(4)}})
    everything = pd.concat(nb._compare(60, 1000)(iter([t.iloc[:90], t.iloc[90:]])))
    for held in (10, 10**6):
        some = pd.concat(nb._compare(60, 20, held=held)(iter([t.iloc[:200], t.iloc[200:]])))
        busy = set(some[some.b.isna()].a)
        both = lambda f: {(a, b) for a, b in zip(f.a, f.b) if not pd.isna(b)}
        assert len(busy) == 100 and both(some) <= both(everything) and len(both(everything)) > 3000
        assert all(a in busy and b in busy for a, b in both(everything) - both(some))


def test_hot_bucket_in_blocks(spark):
    rows = [(i, v) for i, v in enumerate(clusters(n=3, size=60, noise=0.1))]
    got = {(r.id, r.neighbour) for r in nb.nearest(frame(spark, rows), block=16).collect()}
    whole = {(r.id, r.neighbour) for r in nb.nearest(frame(spark, rows)).collect()}
    assert got == whole and len(got) == 1800


def test_copies_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    v, w = rng.standard_normal(100), rng.standard_normal(100)
    near = v + 0.1 * w
    rows = [(i, v) for i in range(1, 16)] + [(2, v), (50, near), (60, w)] + [(70, None), (71, np.zeros(100)), (72, v[:50]), (2**62, near), (None, v), (73, np.full(100, np.nan))]
    got = nb.nearest(frame(spark, rows)).collect()
    of = lambda q: [r.neighbour for r in sorted(got, key=lambda r: r.rank) if r.id == q]
    assert of(1) == list(range(2, 12)) and of(15) == list(range(1, 11)) and of(50) == [2**62, *range(1, 10)] and of(60) == [] and {r.id for r in got} == {*range(1, 16), 50, 2**62}
    assert all(r.similarity >= 0.8 for r in got) and nb.nearest(frame(spark, [(70, None)])).count() == 0
    assert nb.nearest(frame(spark, rows).limit(0)).count() == 0
