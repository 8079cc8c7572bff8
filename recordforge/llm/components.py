"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014).

Edges are first contracted within tasks of a bounded number of edges. What fits in one such task needs no further step.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordforge.llm.store import drop, written


#: Edges that one task contracts.
EDGES = 500_000


def root_of(root: dict[int, int], x: int) -> int:
    """The root of a node in a forest, whose paths are shortened on the way."""
    path = []
    while (up := root.setdefault(x, x)) != x:
        path.append(x)
        x = up
    for y in path:
        root[y] = x
    return x


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a task's edges with the least node that these connect it with."""
    root: dict[int, int] = {}
    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            u, v = root_of(root, u), root_of(root, v)
            root[max(u, v)] = min(u, v)
    pairs = [(x, r) for x in list(root) if (r := root_of(root, x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], names=["u", "v"])


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours to its least neighbour; edges are (u, v) with u > v.

    The least neighbour of each node is a partial aggregate, and a hub's edges meet it in a join, so that no task needs
    all neighbours of a node at once.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """The least node reachable from each node that has an edge.

    edges: columns a and b (long). Loops, repeated edges, either direction and rows with a null are allowed; the last
    are ignored. Returns (node, component), one row for each node with an edge to another; nothing for no edges.
    """
    given = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    tasks = max(1, -(-given.count() // EDGES))
    now = written(given.repartition(tasks).mapInArrow(_contract, "u long, v long"), "edges")
    drop(given)
    count = F.count(F.lit(1))
    mark, before = None, None
    while tasks > 1 and (mark is None or mark != before):
        before = mark
        after = written(_starred(_starred(now, True), False), "edges")
        drop(now)
        now = after
        mark = tuple(now.agg(count, F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    out = written(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    drop(now)
    return out
