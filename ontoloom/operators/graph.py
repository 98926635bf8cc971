"""Graphs of child-parent links: closure, depth, common ancestors, components, cycles. Each loop writes its state to the shared folder."""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ontoloom.session import materialise

#: So many links are walked within one task; more are first reduced by rounds of joins. No result depends on it.
LINKS_PER_TASK = 500_000


def closure(edges: DataFrame, max_hops: int | None = None) -> DataFrame:
    """``node, ancestor, hops``: every ancestor with its least distance; a node on a cycle is its own ancestor. ``edges``: child, parent.

    Distances double: a pair further than ``span`` links is one of exactly ``span`` links and one of at most so many, so that
    the rounds grow with the logarithm of the depth. Only ``max_hops`` limits the distance, where it is given.
    """
    e = edges.select("child", "parent").where("child is not null and parent is not null and child <> parent").distinct()
    known = materialise(e.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("hops")), "closure")
    last, span = known, 1
    while max_hops is None or span < max_hops:
        far = last.where(F.col("hops") == span).select("node", F.col("ancestor").alias("via"))
        rest = known.select(F.col("node").alias("via"), "ancestor", (F.col("hops") + span).alias("hops"))
        if max_hops is not None:
            rest = rest.where(F.col("hops") <= max_hops)
        nxt = far.join(rest, "via").groupBy("node", "ancestor").agg(F.min("hops").alias("hops")).join(known.select("node", "ancestor"), ["node", "ancestor"], "left_anti")
        last = materialise(nxt.select("node", "ancestor", "hops"), "closure")
        if last.isEmpty():
            break
        known = known.unionByName(last)
        span *= 2
    return known


def _levels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Longest paths from the roots, by taking nodes whose parents are all done."""
    links = _links_of(batches)
    down, has_parent = defaultdict(list), set()
    for c, p in links:
        down[p].append(c), has_parent.add(c)
    depth = {n: 0 for n in down if n not in has_parent}
    todo, below = list(depth), set(depth)
    while todo:
        for c in down.get(todo.pop(), ()):
            if c not in below:
                below.add(c), todo.append(c)
    waits: dict = defaultdict(int)
    for c, p in links:
        if p in below:
            waits[c] += 1
    todo, done = list(depth), 0
    while todo:
        n = todo.pop()
        done += 1
        for c in down.get(n, ()):
            depth[c] = max(depth.get(c, 0), depth[n] + 1)
            waits[c] -= 1
            if not waits[c]:
                todo.append(c)
    if done < len(below):
        raise ValueError("a cycle lies below a root: break the cycles first")
    yield pd.DataFrame({"node": list(depth), "depth": list(depth.values())}, dtype=None if depth else object)


def depths(edges: DataFrame, links_per_task: int = LINKS_PER_TASK) -> DataFrame:
    """``node, depth``: the longest path from a root (depth 0) along the links of an acyclic graph; nodes without a root above have none.

    Raises if a cycle lies below a root. More links than one task can hold are walked level by level to the last.
    """
    e = materialise(edges.select("child", "parent").where("child is not null and parent is not null and child <> parent").distinct(), "edges")
    n = e.count()
    if n <= links_per_task:
        return materialise(e.coalesce(1).mapInPandas(_levels, f"node {e.schema['child'].dataType.simpleString()}, depth int"), "depths")
    level = materialise(e.select(F.col("parent").alias("node")).distinct().join(e.select(F.col("child").alias("node")), "node", "left_anti"), "level")
    out, d = level.select("node", F.lit(0).alias("depth")), 0
    while not level.isEmpty():
        d += 1
        if d > n + 1:
            raise ValueError("a cycle lies below a root: break the cycles first")
        level = materialise(level.join(e, level["node"] == e["parent"]).select(F.col("child").alias("node")).distinct(), "level")
        out = out.unionByName(level.select("node", F.lit(d).alias("depth")))
    return out.groupBy("node").agg(F.max("depth").alias("depth"))


def roots_and_leaves(edges: DataFrame) -> DataFrame:
    """``node, kind``: nodes that are no child (root) and nodes that are no parent (leaf)."""
    e = edges.select("child", "parent").where("child is not null and parent is not null and child <> parent")
    c, p = e.select(F.col("child").alias("node")), e.select(F.col("parent").alias("node"))
    return p.distinct().join(c, "node", "left_anti").withColumn("kind", F.lit("root")).unionByName(c.distinct().join(p, "node", "left_anti").withColumn("kind", F.lit("leaf")))


def _join_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each node of the task's links with the smallest node it is connected to within the task (disjoint sets)."""
    up: dict = {}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for c, p in _links_of(batches):
        up.setdefault(c, c), up.setdefault(p, p)
        x, y = top(c), top(p)
        if x != y:
            up[max(x, y)] = min(x, y)
    found = [(n, top(n)) for n in up]
    yield pd.DataFrame({"child": [n for n, _ in found], "parent": [t for _, t in found]}, dtype=None if found else object)


def components(edges: DataFrame, links_per_task: int = LINKS_PER_TASK) -> DataFrame:
    """``node, component``: the smallest node of each node's undirected component.

    Tasks first join the links they hold, which leaves one link per node and task. If one task held all, that is the result. Else labels pass to
    neighbours and jump to the label of the label, until nothing changes, so that rounds grow with the logarithm of the distance.
    """
    e = materialise(edges.select("child", "parent").where("child is not null and parent is not null").distinct(), "links")
    tasks = -(-e.count() // links_per_task) if links_per_task else e.count()
    local = materialise((e.coalesce(1) if tasks <= 1 else e.repartition(tasks)).mapInPandas(_join_sets, e.schema), "edges")
    if tasks <= 1:
        return local.select(F.col("child").alias("node"), F.col("parent").alias("component"))
    both = materialise(local.unionByName(local.select(F.col("parent").alias("child"), F.col("child").alias("parent"))).distinct(), "edges")
    label = materialise(both.groupBy(F.col("child").alias("node")).agg(F.least(F.first("child"), F.min("parent")).alias("component")), "labels")
    while True:
        near = both.join(label.withColumnRenamed("node", "parent"), "parent").groupBy(F.col("child").alias("node")).agg(F.min("component").alias("m"))
        new = label.join(near, "node").select("node", F.least("component", "m").alias("c"), F.col("component").alias("old"))
        jump = label.select(F.col("node").alias("c"), F.col("component").alias("c2"))
        new = materialise(new.join(jump, "c").select("node", F.least("c", "c2").alias("component"), "old"), "labels")
        changed = not new.where("component <> old").isEmpty()
        label = new.select("node", "component")
        if not changed:
            break
    return label


def component_sizes(labels: DataFrame) -> DataFrame:
    """``component, n_nodes``, largest first, of the rows of ``components``."""
    return labels.groupBy("component").agg(F.count("*").alias("n_nodes")).orderBy(F.desc("n_nodes"), "component")


def common_ancestors(pairs: DataFrame, closed: DataFrame, depth: DataFrame) -> DataFrame:
    """``a, b, ancestor``: the deepest common ancestor (a node counts as its own), ties by name; pairs without one have no row."""
    up = closed.select("node", "ancestor").unionByName(depth.select("node", F.col("node").alias("ancestor"))).distinct()
    j = pairs.join(up.withColumnRenamed("node", "a"), "a").join(up.withColumnRenamed("node", "b"), ["b", "ancestor"]).join(depth.withColumnRenamed("node", "ancestor"), "ancestor")
    return j.groupBy("a", "b").agg(F.min(F.struct((-F.col("depth")).alias("d"), "ancestor"))["ancestor"].alias("ancestor"))


def _links_of(batches: Iterator[pd.DataFrame]) -> list[tuple]:
    return [x for b in batches for x in zip(b["child"], b["parent"], strict=True)]


def _peel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links of the task that are left when nodes without a parent or without a child are taken away until there is none."""
    links = _links_of(batches)
    up, down = defaultdict(set), defaultdict(set)
    for c, p in links:
        up[c].add(p), down[p].add(c)
    todo = [n for n in up.keys() | down.keys() if not up.get(n) or not down.get(n)]
    gone = set(todo)
    while todo:
        n = todo.pop()
        for near, back in ((up, down), (down, up)):
            for m in near.get(n, ()):
                back[m].discard(n)
                if not back[m] and m not in gone:
                    gone.add(m), todo.append(m)
    left = [(c, p) for c, p in links if c not in gone and p not in gone]
    yield pd.DataFrame({"child": [c for c, _ in left], "parent": [p for _, p in left]}, dtype=None if left else object)


def cyclic_core(edges: DataFrame, links_per_task: int = LINKS_PER_TASK) -> DataFrame:
    """The links that are left when nodes without a parent and nodes without a child are peeled off again and again.

    Rounds of joins go on until nothing is peeled or one task can hold the rest, which then peels it to the end; the bound doesn't alter the result.
    """
    e = materialise(edges.select("child", "parent").where("child is not null and parent is not null and child <> parent").distinct(), "core")
    n = e.count()
    while n > links_per_task:
        left = e.join(e.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").join(e.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi")
        e = materialise(left.select("child", "parent"), "core")
        m = e.count()
        if m == n:
            return e
        n = m
    return materialise(e.coalesce(1).mapInPandas(_peel, e.schema), "core")


def _strong(graph: dict) -> list[set]:
    """The strongly connected sets of at least two nodes (Tarjan, without recursion)."""
    order, low, on, stack, found = {}, {}, set(), [], []
    for root in graph:
        if root in order:
            continue
        work = [(root, iter(graph[root]))]
        order[root] = low[root] = len(order)
        stack.append(root), on.add(root)
        while work:
            v, it = work[-1]
            for w in it:
                if w not in order:
                    order[w] = low[w] = len(order)
                    stack.append(w), on.add(w)
                    work.append((w, iter(graph[w])))
                    break
                if w in on:
                    low[v] = min(low[v], order[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == order[v]:
                    part = set()
                    while v not in part:
                        w = stack.pop()
                        on.discard(w), part.add(w)
                    if len(part) > 1:
                        found.append(part)
    return found


def _simple_cycles(links: list[tuple]) -> Iterator[list]:
    """Each simple cycle of the links from its smallest node on (Johnson 1975); as long as the cycles are."""
    graph = defaultdict(list)
    for c, p in links:
        graph[c].append(p)
        graph[p]
    todo = _strong(graph)
    while todo:
        part = todo.pop()
        first = min(part)
        sub = {v: [w for w in graph[v] if w in part] for v in part}
        path, blocked, closed, waits = [first], {first}, set(), defaultdict(set)
        work = [(first, list(sub[first]))]
        while work:
            v, near = work[-1]
            if near:
                w = near.pop()
                if w == first:
                    yield list(path)
                    closed.update(path)
                elif w not in blocked:
                    path.append(w), blocked.add(w), closed.discard(w)
                    work.append((w, list(sub[w])))
                continue
            if v in closed:
                free = [v]
                while free:
                    u = free.pop()
                    if u in blocked:
                        blocked.discard(u)
                        free.extend(waits.pop(u, ()))
            else:
                for w in sub[v]:
                    waits[w].add(v)
            work.pop(), path.pop()
        part.discard(first)
        todo.extend(_strong({v: [w for w in sub[v] if w in part] for v in part}))


def _list_cycles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found = _simple_cycles(_links_of(batches))
    while some := list(itertools.islice(found, 10_000)):
        yield pd.DataFrame({"nodes": some})


def cycles(edges: DataFrame, links_per_task: int = LINKS_PER_TASK) -> DataFrame:
    """``nodes, length``: each simple cycle of at least two nodes once, of any length, beginning at its smallest node.

    Only the cyclic core is walked: in one task if it fits, else each of its components within one task.
    """
    e = cyclic_core(edges, links_per_task)
    kind = e.schema["child"].dataType.simpleString()
    if e.count() > links_per_task:
        parts = components(e).withColumnRenamed("node", "child")
        e = e.join(parts, "child").repartition("component").select("child", "parent")
    else:
        e = e.coalesce(1)
    return materialise(e.mapInPandas(_list_cycles, f"nodes array<{kind}>"), "cycles").select("nodes", F.size("nodes").alias("length"))


def _breaking(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links that go: of each strongly connected set that of the greatest (depth of the parent, parent, child), then of what is left of it, to the end."""
    rank = {(c, p): (d, p, c) for b in batches for c, p, d in zip(b["child"], b["parent"], b["d"], strict=True)}
    up = defaultdict(set)
    for c, p in rank:
        up[c].add(p)
        up[p]
    gone, todo = [], _strong(up)
    while todo:
        part = todo.pop()
        _, p, c = max(rank[v, w] for v in part for w in up[v] if w in part)
        up[c].discard(p), gone.append((c, p))
        todo.extend(_strong({v: [w for w in up[v] if w in part] for v in part}))
    yield pd.DataFrame({"child": [c for c, _ in gone], "parent": [p for _, p in gone]}, dtype=None if gone else object)


def break_cycles(edges: DataFrame, depth: DataFrame | None = None, links_per_task: int = LINKS_PER_TASK) -> DataFrame:
    """``child, parent, removed``: the links, those marked whose removal leaves no cycle.

    Self links go first. Then, as long as there is a strongly connected set, its link whose parent is deepest (most specific; without depths or in
    ties: the largest parent, then child) goes; each such link lies on a cycle. No cycle is listed, so that the work doesn't
    grow with their number. Only the cyclic core is walked: in one task if it fits, else each of its components within one task.
    """
    e = edges.select("child", "parent").distinct()
    core = cyclic_core(e, links_per_task)
    if core.count() > links_per_task:
        core = core.join(components(core).withColumnRenamed("node", "child"), "child").repartition("component")
    else:
        core = core.coalesce(1)
    if depth is not None:
        core = core.join(F.broadcast(depth.withColumnRenamed("node", "parent").join(core.select("parent").distinct(), "parent", "left_semi")), "parent", "left") if core.count() <= links_per_task else core.join(depth.withColumnRenamed("node", "parent"), "parent", "left").repartition("component")
    d = F.coalesce("depth", F.lit(-1)) if depth is not None else F.lit(0)
    drop = materialise(core.select("child", "parent", d.cast("int").alias("d")).mapInPandas(_breaking, edges.select("child", "parent").schema), "drop")
    gone = e.where("child = parent").unionByName(drop).withColumn("removed", F.lit(True))
    return e.join(gone, ["child", "parent"], "left").withColumn("removed", F.coalesce("removed", F.lit(False)))


def nearest_ancestors(edges: DataFrame, max_hops: int, max_out: int) -> DataFrame:
    """``node, ancestor, hops, rank``: at most ``max_out`` ancestors of each node within ``max_hops`` links, nearest first, ties by name."""
    order = W.partitionBy("node").orderBy("hops", "ancestor")
    return closure(edges, max_hops).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_out)


def clamp(terms: DataFrame, classes: DataFrame, edges: DataFrame, max_hops: int = 4) -> DataFrame:
    """``term, class, hops``: the term itself if it is a class, else its nearest ancestor that is one, within ``max_hops`` links, ties by name; else null.

    ``terms``: term; ``classes``: term. Repeated and null terms have one and no row.
    """
    t, c = terms.select("term").where("term is not null").distinct(), classes.select("term").where("term is not null").distinct()
    own = t.join(c, "term", "left_semi").select("term", F.struct(F.lit(0).alias("hops"), F.col("term").alias("class")).alias("x"))
    up = closure(edges, max_hops).join(c.withColumnRenamed("term", "ancestor"), "ancestor", "left_semi").where("node <> ancestor")
    far = up.select(F.col("node").alias("term"), F.struct("hops", F.col("ancestor").alias("class")).alias("x"))
    return t.join(own.unionByName(far).groupBy("term").agg(F.min("x").alias("x")), "term", "left").select("term", "x.class", "x.hops")


def nearest_labelled(edges: DataFrame, labels: DataFrame, max_hops: int | None = 10) -> DataFrame:
    """``node, label, hops``: a node's own label (hops 0), else that of its nearest labelled ancestor within ``max_hops`` links (None: any), ties by label.

    ``labels``: node, label.
    """
    up = closure(edges, max_hops)
    own = labels.where("label is not null").select("node", F.lit(0).alias("hops"), "label")
    far = up.join(labels.where("label is not null").withColumnRenamed("node", "ancestor"), "ancestor").select("node", "hops", "label")
    return own.unionByName(far).groupBy("node").agg(F.min(F.struct("hops", "label")).alias("x")).select("node", "x.label", "x.hops")
