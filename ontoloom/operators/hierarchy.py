"""Parent-child links of unknown depth: root, depth, path and descendants of every node, and rings.

Weighted disjoint-set forests: every node keeps a pointer to some ancestor and its offset, the number of links between
them. Tasks combine the links that lie inside them. The forests of the tasks are then merged level by level: nodes that nothing points to are
set aside, a fair part of the others is taken out, in such a way that no two of them follow each other, and what pointed to these points on to their
ancestors with the offsets added. Each level has about half of the nodes of the level before, the last is combined by one task; then the levels are taken
back, each node looking up only the ancestor it pointed to when it was set aside. So a node is read a few times, whatever the depth. A ring is a pointer that comes
back to where it began. Paths are carried along as pieces from a node to the ancestor it points to. Joins use plain equality, so that Spark's skew handling splits parents with very
many children.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.functions.text import label_key
from ontoloom.session import materialise

#: What one task combines in memory; the results don't depend on it.
LINKS_PER_TASK = 100_000
STATE = "node string, ptr string, off long, ring boolean, piece array<string>"


def nodes_of(links: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """``node, parent, n_parents``: every label once, with its parent.

    Labels are compared as ``label_key``. A row with a null or blank parent, or with child equal to parent, adds the label
    without a link; a row with a null or blank child adds its parent only. A label with several distinct parents keeps the
    smallest one in code point order and says how many there were.
    """
    e = links.select(label_key(F.col(child)).alias("c"), label_key(F.col(parent)).alias("p")).distinct()
    pair = F.when(F.col("c").isNull(), F.array()).otherwise(
        F.array(F.struct(F.col("c").alias("node"), F.when(F.col("p") != F.col("c"), F.col("p")).alias("parent")))
    )
    both = F.concat(pair, F.when(F.col("p").isNull(), F.array()).otherwise(F.array(F.struct(F.col("p").alias("node"), F.lit(None).cast("string").alias("parent")))))
    return e.select(F.explode(both).alias("x")).groupBy("x.node").agg(F.min("x.parent").alias("parent"), F.count_distinct("x.parent").cast("int").alias("n_parents"))


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Combine the pointers of one task: each node then points to the first ancestor that is no node of the task; those on or below a ring inside it are marked."""
    parts = list(batches)
    t = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame()
    n = len(t)
    if not n:
        return
    node, end = t["node"].to_numpy(object), t["ptr"].to_numpy(object)
    up = pd.Index(node).get_indexer(pd.Index(end, dtype=object))
    inside = up >= 0
    ptr = np.where(inside, up, np.arange(n))
    last, off, hop = ptr.copy(), t["off"].to_numpy(np.int64) * inside, t["off"].to_numpy(np.int64)
    for _ in range(int(n).bit_length() + 1):
        nxt = last[last]
        if (nxt == last).all():
            break
        off = off + off[last]
        last = nxt
    ring = inside[last]  # the last node would have to point out of the task
    out = pd.DataFrame({"node": node, "ptr": np.where(ring, None, end[last]), "off": np.where(ring, 0, off + hop[last]), "ring": ring, "piece": None})
    if t["piece"].iloc[0] is None:
        yield out
        return
    pieces, rows, size = t["piece"].to_numpy(object), [], 0
    for i in range(n):
        way, x = [], i
        while not ring[i] and inside[x]:
            way.append(x)
            x = ptr[x]
        rows.append(None if ring[i] else [w for y in reversed([*way, x]) for w in pieces[y]])
        size += 1 if ring[i] else len(rows[-1])
        if size > 1_000_000 or i == n - 1:
            yield out.iloc[i + 1 - len(rows) : i + 1].assign(piece=rows)
            rows, size = [], 0


def _ends(nodes: DataFrame, links_per_task: int, with_paths: bool) -> DataFrame:
    """``node, ptr, off, ring, piece``: of every node with a parent its topmost ancestor, the distance, and the path from below that to the node."""
    piece = F.array("node") if with_paths else F.lit(None).cast("array<string>")
    links = nodes.where("parent is not null").select("node", F.col("parent").alias("ptr"), F.lit(1).cast("long").alias("off"), piece.alias("piece"))
    aside: list[DataFrame] = []
    rings: list[DataFrame] = []
    level = 0
    while True:
        # set aside what nothing points to
        met = links.select(F.col("ptr").alias("node"), F.lit(True).alias("met")).distinct()
        flagged = materialise(links.join(met, "node", "left"), "level")
        aside.append(flagged.where("met is null").drop("met"))
        links = flagged.where("met").drop("met")
        left = links.count()
        tasks = max(1, -(-left // links_per_task))
        forest = links.coalesce(1) if tasks == 1 else links.repartition(tasks, "node")
        forest = materialise(forest.mapInPandas(_forest, STATE), "forest")
        if tasks == 1:
            break
        # take out every node of one kind that points to one of the other kind: no two of them follow each other
        kind = lambda c: F.pmod(F.xxhash64(c, F.lit(level)), F.lit(2)) == 0  # noqa: E731, B023
        taken = kind(F.col("node")) & ~kind(F.col("ptr"))
        rings.append(forest.where("ring"))
        aside.append(forest.where(~F.col("ring") & taken).drop("ring"))
        over = aside[-1].select(F.col("node").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("off").alias("off2"), F.col("piece").alias("piece2"))
        rest = forest.where(~F.col("ring") & ~taken).join(over, "ptr", "left")
        on = F.col("ptr2").isNotNull()
        rest = rest.select(
            "node", F.when(on, F.col("ptr2")).otherwise(F.col("ptr")).alias("ptr"), F.when(on, F.col("off") + F.col("off2")).otherwise(F.col("off")).alias("off"),
            F.when(on, F.concat("piece2", "piece")).otherwise(F.col("piece")).alias("piece"),
        )
        rest = materialise(rest, "rest")
        rings.append(rest.where("node = ptr").select("node", F.lit(None).cast("string").alias("ptr"), F.lit(0).cast("long").alias("off"), F.lit(True).alias("ring"), F.lit(None).cast("array<string>").alias("piece")))
        links = rest.where("node <> ptr")
        level += 1
    solved = forest
    for r in rings:
        solved = solved.unionByName(r)
    while aside:
        look = solved.select(F.col("node").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("off").alias("off2"), F.col("ring").alias("ring2"), F.col("piece").alias("piece2"))
        j = aside.pop().join(look, "ptr", "left")
        on, ring = F.col("ring2").isNotNull(), F.coalesce("ring2", F.lit(False))
        new = j.select(
            "node", F.when(ring, None).when(on, F.col("ptr2")).otherwise(F.col("ptr")).alias("ptr"), F.when(on, F.col("off") + F.col("off2")).otherwise(F.col("off")).alias("off"), ring.alias("ring"),
            F.when(ring, None).when(on, F.concat("piece2", "piece")).otherwise(F.col("piece")).alias("piece"),
        )
        solved = solved.unionByName(materialise(new, "solved") if aside else new)
    return solved


def hierarchy(links: DataFrame, child: str = "child", parent: str = "parent", links_per_task: int = LINKS_PER_TASK) -> DataFrame:
    """``node, root, depth, n_parents`` for every label of ``links``; root '' and depth -1 on a ring or below one.

    A label without a parent is its own root at depth 0. Of several parents the smallest is followed, as ``nodes_of`` says; ``n_parents`` tells how many
    there are. No rows give no rows. ``links_per_task`` bounds what one task combines in memory; it doesn't alter the result.
    """
    return paths(links, child, parent, links_per_task, with_paths=False).select("node", "root", "depth", "n_parents")


def paths(links: DataFrame, child: str = "child", parent: str = "parent", links_per_task: int = LINKS_PER_TASK, with_paths: bool = True) -> DataFrame:
    """``node, root, depth, path, on_ring, n_parents``: as ``hierarchy``; the path runs from the root to the node and is null on a ring or below one."""
    nodes = materialise(nodes_of(links, child, parent), "nodes")
    ends = _ends(nodes, links_per_task, with_paths).select("node", "ptr", "off", "ring", "piece")
    tops = nodes.where("parent is null").select("node", F.col("node").alias("ptr"), F.lit(0).cast("long").alias("off"), F.lit(False).alias("ring"), F.lit(None).cast("array<string>").alias("piece"))
    path = F.when(F.col("off") == 0, F.array("node")).otherwise(F.concat(F.array("ptr"), "piece"))
    several = nodes.where("n_parents > 1").select("node", "n_parents")
    out = ends.withColumn("n", F.lit(1)).unionByName(tops.withColumn("n", F.lit(0))).join(several, "node", "left")
    return out.select(
        "node", F.when(F.col("ring"), "").otherwise(F.col("ptr")).alias("root"), F.when(F.col("ring"), -1).otherwise(F.col("off")).cast("int").alias("depth"), F.when(~F.col("ring"), path).alias("path"),
        F.col("ring").alias("on_ring"), F.coalesce("n_parents", "n").cast("int").alias("n_parents"),
    )


def descendants(with_paths: DataFrame) -> DataFrame:
    """``node, descendant, distance`` for every pair of a node and a node below it, from the rows of ``paths``."""
    steps = F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("at", "node")
    return with_paths.where("depth > 0").select(F.col("node").alias("descendant"), "depth", steps).select("node", "descendant", (F.col("depth") - F.col("at")).cast("int").alias("distance"))
