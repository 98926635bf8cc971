"""Frequencies, distinctiveness and format duplicates against brute force, with nulls, repeats, hot terms, clashing columns and empty tables."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from ontoloom.llm import format_duplicates as fd
from ontoloom.llm import frequencies as fq

OCC = "term_id long, doc_id long, sent_idx int, token_start int, token_end int, cleaned_version int, lemma string, n int, stretch int"
CAND = "term_id long, term_lemma string, lemma string, lemma_id int"


def make(spark, seed, n=1500):
    rnd = random.Random(seed)
    cand = [(i, f"Term  {i % 25}" if i % 3 else f"term {i % 25} ", "x", 1) for i in range(40)] + [(None, "a", "x", 1), (90, None, "x", 1), (91, " ", "x", 1), (1, "Term  1", "x", 1)]
    occ = []
    for _ in range(n):
        t = 0 if rnd.random() < 0.34 else rnd.choice([*range(1, 45), None])
        row = (t, rnd.choice([*range(9000), None]) if rnd.random() < 0.5 else rnd.randrange(6), rnd.choice([1, 2, None]), rnd.randrange(3), rnd.choice([5, None]), rnd.randrange(3), "y", 7, 8)
        occ += [row] * (2 if rnd.random() < 0.1 else 1)
    return cand, occ


def brute(cand, occ):
    key = lambda s: " ".join(s.lower().split()) if s and s.split() else None
    ids = defaultdict(set)
    for t, lem, *_ in cand:
        if t is not None and key(lem):
            ids[t].add(key(lem))
    seen = {(lem, *o[1:5]) for o in occ if o[1] is not None and o[0] is not None for lem in ids.get(o[0], ())}
    tf = Counter((lem, d) for lem, d, *_ in seen)
    total, docs = Counter(), defaultdict(set)
    for (lem, d), n in tf.items():
        total[lem] += n
        docs[lem].add(d)
    return {key(lem) for _, lem, *_ in cand if key(lem)}, tf, total, docs, len({d for _, d in tf})


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_frequencies(spark, broadcast_rows):
    cand, occ = make(spark, 3)
    lemmas, _, total, docs, n = brute(cand, occ)
    got = {r.term_lemma: r for r in fq.term_frequencies(spark.createDataFrame(occ, OCC), spark.createDataFrame(cand, CAND), broadcast_rows=broadcast_rows).collect()}
    assert set(got) == lemmas
    for lem, r in got.items():
        assert (r.freq_total, r.freq_docs, r.too_rare, r.too_common) == (total[lem], len(docs[lem]), len(docs[lem]) < 3, len(docs[lem]) > 0.08 * n)


def test_distinctiveness(spark):
    cand, occ = make(spark, 5)
    _, tf, _, docs, n = brute(cand, occ)
    rows = fq.distinctiveness(spark.createDataFrame(occ, OCC), spark.createDataFrame(cand, CAND)).collect()
    assert len(rows) == len(tf)
    want = defaultdict(list)
    for (lem, d), k in tf.items():
        want[d].append((-k * (math.log((n + 1) / (len(docs[lem]) + 1)) + 1), lem))
    order = {(d, lem): i + 1 for d, x in want.items() for i, (_, lem) in enumerate(sorted((round(s, 9), lem) for s, lem in x))}
    for r in rows:
        assert r.n == tf[(r.term_lemma, r.doc_id)] and 0 <= r.elite_p <= 1 and abs(r.score - r.n * r.idf) < 1e-9 and r.rank == order[(r.doc_id, r.term_lemma)]
    top = fq.distinctiveness(spark.createDataFrame(occ, OCC), spark.createDataFrame(cand, CAND), top=2)
    assert top.count() == sum(min(2, len(x)) for x in want.values())


def test_empty(spark):
    occ, cand = spark.createDataFrame([], OCC), spark.createDataFrame([(1, "a", "x", 1)], CAND)
    r = fq.term_frequencies(occ, cand).collect()
    assert len(r) == 1 and r[0].freq_docs == 0 and r[0].too_rare and not r[0].too_common
    assert fq.term_frequencies(occ, cand.limit(0)).count() == 0 and fq.distinctiveness(occ, cand).count() == 0


def test_two_poisson_finds_the_mixture():
    rng = np.random.default_rng(1)
    k = np.where(rng.random(20000) < 0.1, rng.poisson(6, 20000), rng.poisson(0.3, 20000))
    v, w = np.unique(k, return_counts=True)
    share, elite, other = fq.fit_two_poisson(v.astype(float), w.astype(float), np.zeros(len(v), int), 1, 200)
    assert abs(share[0] - 0.1) < 0.02 and abs(elite[0] - 6) < 0.4 and abs(other[0] - 0.3) < 0.05
    p = fq._posterior(np.array([0.0, 2.0, 8.0]), share, elite, other)
    assert p[0] < 0.01 and p[2] > 0.99 and (np.diff(p) > 0).all()


TERMS = [(1, "Big-Cache 2", "q"), (2, "cache, big (2)", "q"), (3, "cache big", "q"), (4, None, "q"), (5, "  ", "q"), (6, "...", "q"), (7, "cache cache big", "q"), (8, "CACHE​BIG", "q"), (1, "Big-Cache 2", "q"), (9, "größe ", "q"), (10, "GRÖẞE".lower(), "q"), (None, "cache big", "q")]


def test_format_duplicates(spark):
    df = spark.createDataFrame(TERMS, "term_id long, term string, id string")
    got = {r.id: (r.keep_id, r.n_copies) for r in fd.collapse(df, "term_id", ["term"]).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 2), 8: (3, 2), 7: (7, 1), 9: (9, 2), 10: (9, 2)}
    assert {(r.keep_id, r.n_copies) for r in fd.unique(df, "term_id", ["term"]).collect()} == {(1, 2), (3, 2), (7, 1), (9, 2)}
    assert fd.collapse(df.limit(0), "term_id", ["term"]).count() == 0


def test_format_duplicates_of_records(spark):
    df = spark.createDataFrame([(1, "A b", "x"), (2, "b, a", "X!"), (3, "x", "a b"), (4, None, "x"), (5, None, " X"), (6, None, None)], "id long, f string, tuple string")
    got = {r.id: r.keep_id for r in fd.collapse(df, "id", ["f", "tuple"]).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_hot_group(spark):
    df = spark.range(6000).selectExpr("id", "case when id % 3 = 0 then concat('Same', repeat(' ', int(id % 5) + 1), 'TERM') else concat('t', id) end term")
    got = fd.unique(df, "id", ["term"])
    assert got.where("n_copies = 2000 and keep_id = 0").count() == 1 and got.count() == 4001


def slow_posterior(hist, k, rounds=40):
    """The posterior of one term by plain loops; ``hist``: occurrences -> records."""
    n, total = sum(hist.values()), sum(c * w for c, w in hist.items())
    present = sum(w for c, w in hist.items() if c)
    share, elite, other = min(0.5, max(1e-9, present / n * 0.5)), total / present * 1.5, max(total / n * 0.5, 1e-9)
    post = lambda c: 1 / (1 + (1 - share) / share * math.exp(min(700, max(-700, c * math.log(other / elite) + elite - other))))
    for _ in range(rounds):
        e = {c: w * post(c) for c, w in hist.items()}
        se, so = sum(e.values()), n - sum(e.values())
        share, elite, other = min(1 - 1e-12, max(se / n, 1e-12)), max(sum(c * x for c, x in e.items()) / max(se, 1e-12), 1e-9), max(sum(c * (hist[c] - x) for c, x in e.items()) / max(so, 1e-12), 1e-12)
    if other > elite:
        share, elite, other = 1 - share, other, elite
    return post(k)


def test_posterior_against_plain_loops(spark):
    cand, occ = make(spark, 8)
    _, tf, _, docs, n = brute(cand, occ)
    rows = fq.distinctiveness(spark.createDataFrame(occ, OCC), spark.createDataFrame(cand, CAND)).collect()
    hist = defaultdict(lambda: defaultdict(int))
    for (lem, _), k in tf.items():
        hist[lem][k] += 1
    for lem, h in hist.items():
        if (left := n - len(docs[lem])) > 0:
            h[0] += left
    assert len(rows) == len(tf)
    for r in rows:
        assert abs(r.elite_p - slow_posterior(dict(hist[r.term_lemma]), r.n)) < 1e-6, (r, dict(hist[r.term_lemma]))
