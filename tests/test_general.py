"""Hierarchies and missing references against brute force, with nulls, repeats, rings and empty tables."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ontoloom.operators import hierarchy as h
from ontoloom.operators import references as r


def brute(edges):
    key = lambda x: " ".join(x.lower().split()) if x and x.split() else None
    par, nodes = {}, set()
    for c, p in edges:
        c, p = key(c), key(p)
        nodes |= {x for x in (c, p) if x}
        if c and p and c != p:
            par[c] = min(par.get(c, p), p)
    out = {}
    for n in nodes:
        x, d, seen = n, 0, set()
        while x in par and x not in seen:
            seen.add(x)
            x, d = par[x], d + 1
        out[n] = ("", -1) if x in seen else (x, d)
    return out


def result(spark, edges, per_task=3):
    df = spark.createDataFrame(edges or [], "child string, parent string, node string, root string") if not edges else spark.createDataFrame([(c, p, "x", "y") for c, p in edges], "child string, parent string, node string, root string")
    return df, {x.node: (x.root, x.depth) for x in h.hierarchy(df, links_per_task=per_task).collect()}


CASES = {
    "empty": [],
    "nulls": [(None, None), (None, "a"), ("b", None), ("c", " "), ("d", "D")],
    "spelling": [("Big  Tree", "root x"), ("big tree", "ROOT X"), ("leaf", "BIG\tTREE")],
    "ring": [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "f")],
    "two parents": [("a", "c"), ("a", "b")],
    "deep": [(f"n{i}", f"n{i + 1}") for i in range(200)],
    "long ring": [(f"n{i}", f"n{(i + 1) % 90}") for i in range(90)] + [("t", "n0")],
}


@pytest.mark.parametrize("case", CASES)
def test_hierarchy(spark, case):
    _, got = result(spark, CASES[case], per_task=40)
    assert got == brute(CASES[case])


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 10**6))
def test_hierarchy_random(spark, seed):
    rnd = random.Random(seed)
    edges = [(f"n{rnd.randrange(60)}", f"n{rnd.randrange(60)}") for _ in range(rnd.randrange(80))]
    assert result(spark, edges, per_task=7)[1] == brute(edges)


def test_paths_and_descendants(spark):
    df, got = result(spark, CASES["ring"] + [("x", "y"), ("y", "z")])
    p = {x.node: x.path for x in h.paths(df).collect()}
    assert p["x"] == ["z", "y", "x"] and p["e"] == ["f", "e"] and p["a"] is None and p["z"] == ["z"]
    d = {(x.node, x.descendant, x.distance) for x in h.descendants(h.paths(df)).collect()}
    assert d == {("z", "y", 1), ("z", "x", 2), ("y", "x", 1), ("f", "e", 1)}


@pytest.mark.parametrize("per_task", [30, 100_000])
def test_paths_over_levels(spark, per_task):
    rnd = random.Random(9)
    edges = [(f"n{i}", f"n{max(0, i - rnd.randrange(1, 4))}") for i in range(1, 300)] + [(f"m{i}", f"m{(i + 1) % 40}") for i in range(40)] + [("k", "m3"), ("n299", "n5"), ("n299", "zz")]
    df, want = spark.createDataFrame(edges, "child string, parent string"), brute(edges)
    got = h.paths(df, links_per_task=per_task).collect()
    assert {x.node: (x.root, x.depth) for x in got} == want
    for x in got:
        assert x.on_ring == (x.depth < 0) and (x.path is None) == x.on_ring
        if not x.on_ring:
            assert x.path[0] == x.root and x.path[-1] == x.node and len(x.path) == x.depth + 1
            assert all((c, p) in edges or (c == "n299") for p, c in zip(x.path, x.path[1:]))
    assert {x.node: x.n_parents for x in got if x.node in ("n0", "n1", "n299")} == {"n0": 0, "n1": 1, "n299": 3}


def test_references(spark):
    refs = spark.createDataFrame([(1, "2023-01-05", "p"), (1, "2023-01-05", "p"), (2, None, "p"), (None, None, "p"), (3, "2023-02-01", "q"), (9, "2023-02-01", "q")], "id int, at string, target string")
    keys = spark.createDataFrame([(1, "2023-01-01"), (1, "2023-06-01"), (3, "2023-03-01"), (None, None)], "id int, made string")
    got = r.orphan_references(
        [r.Reference(refs, "refs", "id", "keys", r.month_of(F.to_timestamp("at")), F.to_timestamp("at"))], [r.Target(keys, "keys", "id", F.to_timestamp("made"))]
    ).collect()
    assert {(x.ref_id, x.period, x.reason, x.n_refs) for x in got} == {(2, "none", "missing", 1), (3, "2023-02", "later", 1), (9, "2023-02", "missing", 1)}
    text = spark.createDataFrame([("a",), ("b",), ("3",), (None,)], "id string")
    got = r.orphan_references([r.Reference(text, "refs", "id", "keys", F.lit("x")), r.Reference(refs, "nums", "id", "keys", F.lit("x"))], [r.Target(spark.createDataFrame([("a",), ("3",)], "id string"), "keys", "id")])
    assert {(x.ref_table, x.ref_id) for x in got.collect()} == {("refs", "b"), ("nums", "1"), ("nums", "2"), ("nums", "9")}
    none = r.orphan_references([r.Reference(refs.limit(0), "refs", "id", "keys", F.lit("x"))], [r.Target(keys.limit(0), "keys", "id")])
    assert none.count() == 0
    assert r.orphan_references([r.Reference(refs, "refs", "id", "keys", F.lit("x"))], [r.Target(keys.limit(0), "keys", "id")]).count() == 4
