"""The nearest vectors of every vector, without a least similarity, against brute force."""

import numpy as np
import pytest

from ontoloom.llm import neighbours


@pytest.mark.parametrize("blocks", [(16_384, 65_536), (20, 70)])
def test_every_vector_has_k(spark, blocks):
    v = np.random.default_rng(3).normal(size=(150, 20)).astype(np.float32)
    v[10:25] = v[9]
    v[40] = 2 * v[39]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, [0.0] * 20), (901, None), (902, [1.0]), (None, v[0].tolist()), (3, v[3].tolist())]
    df = spark.createDataFrame(rows, "term_id long, vec array<float>")
    got = {(x.id, x.rank): (x.neighbour, x.similarity) for x in neighbours.exact_nearest(df, 10, dim=20, queries_per_task=blocks[0], vectors_per_task=blocks[1]).collect()}
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    assert len(got) == 1500
    for i in range(150):
        want = sorted((-s[i, j], j) for j in range(150) if j != i)[:10]
        assert [got[i, r + 1][0] for r in range(10)] == [j for _, j in want]
        assert all(abs(got[i, r + 1][1] + want[r][0]) < 1e-9 for r in range(10))


def test_chosen_queries(spark):
    v = np.random.default_rng(5).normal(size=(60, 20)).astype(np.float32)
    v[1] = v[0] + 0.1 * v[2]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "term_id long, vec array<float>")
    got = neighbours.exact_nearest(df, 3, dim=20, queries=spark.createDataFrame([(0,), (7,), (7,), (999,), (None,)], "id long"), min_similarity=0.9).collect()
    assert [(x.id, x.neighbour, x.rank) for x in got] == [(0, 1, 1)]
