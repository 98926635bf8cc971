"""Graph operators beyond every former limit: long rings, deep chains, against brute force."""

import random

import pytest

from ontoloom.operators import graph
from ontoloom.plans import registry

LINKS = "child string, parent string"


def brute_cycles(links):
    up, found = {}, set()
    for c, p in links:
        if c != p:
            up.setdefault(c, set()).add(p)

    def walk(path):
        for p in up.get(path[-1], ()):
            if p == path[0]:
                found.add(tuple(path))
            elif p > path[0] and p not in path:
                walk([*path, p])

    for n in up:
        walk([n])
    return found


@pytest.mark.parametrize("per_task", [0, 500_000])
def test_cycles_of_any_length(spark, per_task):
    ring = [(f"n{i:03}", f"n{(i + 1) % 300:03}") for i in range(300)]
    e = spark.createDataFrame([*ring, ("n000", "n010"), ("x", "n005"), ("n007", "y"), ("y", "z"), ("s", "s")], LINKS)
    assert sorted(x.length for x in graph.cycles(e, per_task).collect()) == [291, 300]


def test_long_rings_are_broken(spark):
    ring = [(f"n{i:03}", f"n{(i + 1) % 90:03}") for i in range(90)]
    e = spark.createDataFrame([*ring, ("n000", "n040"), ("x", "n005")], LINKS)
    left = [(x.child, x.parent) for x in graph.break_cycles(e).where("not removed").collect()]
    assert not brute_cycles(left) and len(left) == 91


@pytest.mark.parametrize("seed", range(4))
def test_random_cycles(spark, seed):
    rnd = random.Random(seed)
    links = sorted({(f"n{rnd.randrange(14):02}", f"n{rnd.randrange(14):02}") for _ in range(30)})
    got = [tuple(x.nodes) for x in graph.cycles(spark.createDataFrame(links, LINKS), 0 if seed % 2 else 500_000).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_cycles(links)


def test_is_a_rings(spark, data):
    left = registry.QUERIES["cycle_break"](spark, data).where("not removed").select("child", "parent")
    assert graph.cycles(left).count() == 0


def brute_closure(links):
    up, out = {}, {}
    for c, p in links:
        if c != p:
            up.setdefault(c, set()).add(p)
    for n in up:
        level, hops = up[n], 1
        while level:
            for a in level:
                out[n, a] = hops
            level, hops = {p for a in level for p in up.get(a, ()) if (n, p) not in out}, hops + 1
    return out


CHAIN = [(f"n{i:03}", f"n{i + 1:03}") for i in range(150)]


@pytest.mark.parametrize("links", [CHAIN, [*CHAIN, ("n150", "n020"), ("n010", "n140")]], ids=["chain", "ring"])
def test_deep_closure(spark, links):
    e = spark.createDataFrame(links, LINKS)
    want = brute_closure(links)
    assert {(x.node, x.ancestor): x.hops for x in graph.closure(e).collect()} == want
    assert {(x.node, x.ancestor): x.hops for x in graph.closure(e, 10).collect()} == {k: h for k, h in want.items() if h <= 10}


def test_deep_depths(spark):
    e = spark.createDataFrame([*CHAIN, ("n020", "n150"), ("n000", "n140"), ("p", "q"), ("q", "p"), ("n000", "q")], LINKS)
    acyclic = e.where("not (child = 'n020' and parent = 'n150')")
    got = {x.node: x.depth for x in graph.depths(acyclic).collect()}
    assert got == {f"n{i:03}": 150 - i for i in range(151)}


@pytest.mark.parametrize("per_task", [0, 500_000])
def test_depths_raise_on_a_cycle_below_a_root(spark, per_task):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "root")], LINKS)
    with pytest.raises(Exception, match="cycle lies below a root"):
        graph.depths(e, per_task).count()


def test_depths_by_levels(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("d", "c")], LINKS)
    assert {x.node: x.depth for x in graph.depths(e, 0).collect()} == {"c": 0, "b": 1, "d": 1, "a": 2}


@pytest.mark.parametrize("per_task", [40, 500_000])
def test_components(spark, per_task):
    rnd = random.Random(3)
    links = [(f"n{rnd.randrange(300):03}", f"n{rnd.randrange(300):03}") for _ in range(160)] + CHAIN[100:] + [("n000", None), (None, "n001"), ("solo", "solo")]
    label = {n: n for c, p in links if c and p for n in (c, p)}
    changed = True
    while changed:
        changed = False
        for c, p in links:
            if c and p and label[c] != label[p]:
                label[c] = label[p] = min(label[c], label[p])
                changed = True
    got = graph.components(spark.createDataFrame(links, LINKS), per_task)
    assert {x.node: x.component for x in got.collect()} == label
    sizes = {x.component: x.n_nodes for x in graph.component_sizes(got).collect()}
    assert sizes == {c: list(label.values()).count(c) for c in label.values()}
    assert graph.components(spark.createDataFrame([], LINKS)).count() == 0


def test_break_cycles_leaves_none_and_takes_deep_links(spark):
    rnd = random.Random(5)
    links = sorted({(f"n{rnd.randrange(40):02}", f"n{rnd.randrange(40):02}") for _ in range(220)})
    e = spark.createDataFrame([*links, ("a", "a")], LINKS)
    got = graph.break_cycles(e).collect()
    left = [(x.child, x.parent) for x in got if not x.removed]
    done = set()
    while any(c not in done for c, _ in left):
        new = {c for c, _ in left if c not in done and all(p in done or p not in {x for x, _ in left} for y, p in left if y == c)}
        assert new, "a cycle is left"
        done |= new
    depth = spark.createDataFrame([("x", 1), ("y", 5), ("z", 3)], "node string, depth int")
    ring = spark.createDataFrame([("x", "y"), ("y", "z"), ("z", "x"), ("w", "x")], LINKS)
    assert [(x.child, x.parent) for x in graph.break_cycles(ring, depth).where("removed").collect()] == [("x", "y")]


def test_clamp_and_nearest_ancestors(spark):
    e = spark.createDataFrame(CHAIN[:12], LINKS)
    terms, classes = spark.createDataFrame([("n000",), ("n006",), ("n009",), ("zz",), (None,)], "term string"), spark.createDataFrame([("n006",), ("n012",), (None,)], "term string")
    got = {x.term: (x["class"], x.hops) for x in graph.clamp(terms, classes, e).collect()}
    assert got == {"n000": (None, None), "n006": ("n006", 0), "n009": ("n012", 3), "zz": (None, None)}
    near = [(x.ancestor, x.hops) for x in graph.nearest_ancestors(e, 5, 3).where("node = 'n000'").orderBy("rank").collect()]
    assert near == [("n001", 1), ("n002", 2), ("n003", 3)]
