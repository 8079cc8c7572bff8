"""A Merkle manifest of a table: one tree for each source over its rows, and one tree over the sources' roots.

Rows are digested where they are read; only digests travel. They are put in order by a range sort and indexed within
their tree. Each slice of the order is then worked through with a mountain-range stack: a digest is pushed, and whenever
it ends a run of FANOUT nodes (or is the last of its level) the run is carried into its parent. What a slice completes
are node records; what stays on its stack are the peaks of its right edge and nodes of its unaligned left edge, whose
runs began in an earlier slice. Those few are merged by the same stack over so many times more rows a round. A last
run is hashed as short as it is; nothing is padded.

Proofs come down again in bands of some levels: a task holds one subtree of a band and the path that leads from its top
to the root, so that no task ever holds a whole tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordforge.llm.store import written

FANOUT = 3


@dataclass(frozen=True)
class Shape:
    """How much one task works on: rows of a slice (a power of two), parts of the order that it merges in a round, and levels that it proves."""

    slice_bits: int = 16
    merge: int = 64
    band: int = 7


_STACK = "tree string, size long, part long, level int, pos long, digest string, fresh boolean, open boolean, root boolean"
_TAIL = "array<struct<place:int,others:array<string>>>"
_ARROW_TAIL = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.list_(pa.string()))]))


def hashed(*digests: str) -> str:
    """Lower-case hex SHA-256 of hex texts, one after the other."""
    return sha256("".join(digests).encode()).hexdigest()


def row_digest(*fields: Column) -> Column:
    """A leaf: each field is ``-`` if null, else its count of UTF-8 bytes, a colon and its value; integers are decimal."""
    said = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in fields]
    return F.sha2(F.concat(*said), 256)


def count_at(size: int, level: int) -> int:
    """Nodes of a level of a tree with so many leaves."""
    for _ in range(level):
        size = -(-size // FANOUT)
    return size


def carry(rows: Iterator[tuple[int, int, str]], size: int) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Push nodes (level, place, digest), in the order of their leaves, on a mountain-range stack of a tree of ``size`` leaves.

    Returns the nodes made and what stays on the stack. A run is carried once all its nodes lie on top of each other.
    """
    counts = [size]
    while counts[-1] > 1:
        counts.append(count_at(counts[-1], 1))
    made, stack = [], []
    for level, pos, digest in rows:
        stack.append((level, pos, digest))
        while counts[level] > 1 and (pos % FANOUT == FANOUT - 1 or pos == counts[level] - 1):
            run = stack[-(pos % FANOUT + 1) :]
            if [x[:2] for x in run] != [(level, p) for p in range(pos - pos % FANOUT, pos + 1)]:
                break
            del stack[-len(run) :]
            level, pos = level + 1, pos // FANOUT
            stack.append((level, pos, hashed(*(x[2] for x in run))))
            made.append(stack[-1])
    return made, stack


def _stacked(table: pa.Table) -> pa.Table:
    """One group's nodes through the stack, tree by tree."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["tree"], r["pos"] * FANOUT ** r["level"], r["level"]))
    out = []
    at = 0
    while at < len(rows):
        tree, size, end = rows[at]["tree"], rows[at]["size"], at
        while end < len(rows) and rows[end]["tree"] == tree:
            end += 1
        made, left = carry(((r["level"], r["pos"], r["digest"]) for r in rows[at:end]), size)
        fresh, part = {x[:2] for x in made}, rows[at]["part"]
        kept = {x[:2] for x in left}
        for level, pos, digest in made + [x for x in left if x[:2] not in fresh]:
            root = count_at(size, level) == 1
            out.append((tree, size, part, level, pos, digest, (level, pos) in fresh or root, (level, pos) in kept and not root, root))
        at = end
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_())
    names = ("tree", "size", "part", "level", "pos", "digest", "fresh", "open", "root")
    columns = list(zip(*out, strict=True)) or [[] for _ in names]
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})


def indexed(leaves: DataFrame, shape: Shape) -> tuple[DataFrame, int]:
    """Leaves (tree, k, digest, tie, ...) with their place within their tree, its size and their part and slice of the order; and the number of parts.

    The places of a part's rows follow from counts of each tree and part, of which a tree has no more than there are parts.
    """
    order = ["tree", "k", "digest", "tie"]
    ordered = written(leaves.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("mid", F.monotonically_increasing_id()), "merkle-order")
    ordered = ordered.withColumn("part", F.shiftright("mid", 33))
    counts = ordered.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"), F.min("mid").alias("first"))
    of = Window.partitionBy("tree")
    starts = counts.select("tree", "part", "first", (F.sum("n").over(of.orderBy("part")) - F.col("n")).alias("start"), F.sum("n").over(of).alias("size"))
    out = ordered.join(starts, ["tree", "part"]).withColumn("pos", F.col("start") + F.col("mid") - F.col("first")).withColumn("slice", F.shiftright("mid", shape.slice_bits))
    return out.drop("first", "start", "mid"), (counts.agg(F.max("part")).first()[0] or 0) + 1


def build(leaves: DataFrame, parts: int, shape: Shape) -> DataFrame:
    """Node records (tree, size, level, pos, digest, root) of indexed leaves: all nodes above the leaves, and lone leaves as roots."""
    columns = ["tree", "size", "part", F.lit(0).alias("level"), "pos", "digest"]
    found = [written(leaves.select(*columns, "slice").groupBy("slice").applyInArrow(_stacked, _STACK), "merkle-nodes")]
    span = 1
    while True:
        span *= shape.merge
        group = F.floor(F.col("part") / F.lit(span)).alias("merged")
        found.append(written(found[-1].where("open").select("tree", "size", "part", "level", "pos", "digest", group).groupBy("merged").applyInArrow(_stacked, _STACK), "merkle-nodes"))
        if span >= parts:
            break
    return reduce(DataFrame.unionAll, [x.where("fresh") for x in found]).select("tree", "size", "level", "pos", "digest", "root")


def _climb(levels: list[dict[int, str]], size: int, base: int, pos: int, top: int) -> list[tuple[int, list[str]]]:
    """The path from node ``pos`` of level ``base`` up to level ``top``: its place in each run, and the run's others."""
    path = []
    for o in range(top - base):
        first = pos - pos % FANOUT
        run = range(first, min(first + FANOUT, count_at(size, base + o)))
        path.append((pos - first, [levels[o][p] for p in run if p != pos]))
        pos //= FANOUT
    return path


def _block(members: pa.Table, tails: pa.Table, base: int, height: int) -> tuple[list[dict], dict, int, list[dict[int, str]]]:
    rows, tail = members.to_pylist(), tails.to_pylist()[0]
    levels: list[dict[int, str]] = [{} for _ in range(height)]
    for r in rows:
        levels[r["level"] - base][r["pos"]] = r["digest"]
    return [r for r in rows if r["level"] == base], tail, min(base + height, tail["top"]), levels


def _said(path: list[tuple[int, list[str]]]) -> list[dict]:
    return [{"place": place, "others": others} for place, others in path]


def _down(base: int, height: int):
    """The paths of a band's lowest nodes, each of which is the top of a block of the next band."""

    def run(members: pa.Table, tails: pa.Table) -> pa.Table:
        low, tail, top, levels = _block(members, tails, base, height)
        paths = [_said(_climb(levels, tail["size"], base, r["pos"], top)) + tail["tail"] for r in low]
        n = len(low)
        return pa.table({"tree": [tail["tree"]] * n, "block": pa.array([r["pos"] for r in low], pa.int64()), "size": pa.array([tail["size"]] * n, pa.int64()), "top": pa.array([tail["top"]] * n, pa.int32()), "subroot": [tail["subroot"]] * n, "root": [tail["root"]] * n, "tail": pa.array(paths, _ARROW_TAIL)})

    return run


def _proved(height: int):
    """Proofs of a block's leaves, and the root that each leaf, or what it was changed to, folds to."""

    def run(members: pa.Table, tails: pa.Table) -> pa.Table:
        low, tail, top, levels = _block(members, tails, 0, height)
        above = [(x["place"], x["others"]) for x in tail["tail"]]
        end = "".join(d for _, others in above for d in others)
        proofs, roots = [], []
        for r in low:
            path = _climb(levels, tail["size"], 0, r["pos"], top)
            proofs.append(hashed(*(d for _, others in path for d in others), end))
            at = r["changed"] or r["digest"]
            for place, others in path + above:
                at = hashed(*others[:place], at, *others[place:])
            roots.append(at)
        n = len(low)
        return pa.table({"id": pa.array([r["id"] for r in low], pa.int64()), "leaf": [r["digest"] for r in low], "subroot": [tail["subroot"]] * n, "root": [tail["root"]] * n, "proof_sha256": proofs, "folded_root": roots, "verified": [x == tail["root"] for x in roots]})

    return run


def _paths(height: int):
    """The path of each leaf of a block to the root; a leaf is named by its column ``changed``."""

    def run(members: pa.Table, tails: pa.Table) -> pa.Table:
        low, tail, top, levels = _block(members, tails, 0, height)
        paths = [_said(_climb(levels, tail["size"], 0, r["pos"], top)) + tail["tail"] for r in low]
        return pa.table({"tree": [r["changed"] for r in low], "root": [tail["root"]] * len(low), "tail": pa.array(paths, _ARROW_TAIL)})

    return run


def _block_of(base: int, height: int) -> Column:
    """The block that a node is in, of the band from level ``base`` on."""
    width = reduce(lambda c, o: F.when(F.col("level") == base + o, F.lit(FANOUT ** (height - o))).otherwise(c), range(height), F.lit(1))
    return F.floor(F.col("pos") / width)


def _blocks(leaves: DataFrame, nodes: DataFrame, tops: DataFrame, height: int) -> tuple[DataFrame, DataFrame]:
    """Members (tree, block, level, pos, digest, id, changed) of the lowest band's blocks, and the path above each block.

    tops: (tree, size, top, subroot, root, tail), with a tree's level, its root and the path that leads on from there.
    """
    named = ["tree", "block", "size", "top", "subroot", "root", "tail"]
    tops = written(tops.withColumn("band", F.floor(F.greatest(F.col("top") - 1, F.lit(0)) / height)).withColumn("block", F.lit(0).cast("long")), "merkle-tops")
    last = tops.agg(F.max("band")).first()[0] or 0
    tails = None
    for band in range(last, -1, -1):
        own = tops.where(F.col("band") == band).select(*named)
        tails = own if tails is None else tails.unionByName(own)
        if band:
            members = nodes.where(~F.col("root") & F.col("level").between(band * height, band * height + height - 1)).select("tree", _block_of(band * height, height).alias("block"), "level", "pos", "digest")
            below = members.groupBy("tree", "block").cogroup(tails.groupBy("tree", "block")).applyInArrow(_down(band * height, height), f"tree string, block long, size long, top int, subroot string, root string, tail {_TAIL}")
            tails = written(below, "merkle-paths")
    low = leaves.select("tree", F.lit(0).alias("level"), "pos", "digest", "id", "changed")
    high = nodes.where(F.col("level").between(1, height - 1)).select("tree", "level", "pos", "digest", F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("changed"))
    members = low.unionByName(high)
    return members.withColumn("block", _block_of(0, height)), tails


def manifest(docs: DataFrame, fields: list[str], id_col: str = "doc_id", tree_col: str = "source", changed: dict[str, Column] | None = None, shape: Shape = Shape()) -> DataFrame:
    """A row for each row of ``docs``: (id, leaf, subroot, root, proof_sha256, folded_root, verified).

    fields: the columns that a leaf digests, in order. changed: other values of some of them, with which rows are checked
    against the manifest: folded_root comes from the changed leaf and the original's siblings, and verified says if it is
    the root. Within a tree leaves ascend by id (null first; rows of one id by their digest, so that equal rows are
    interchangeable). A null source has a tree of its own, before all others. A very long text is digested where it is
    read. An empty table gives no rows. Other columns, whatever their names, have no part.
    """
    col = lambda n: F.col(f"`{n}`")
    leaf = row_digest(*(col(f) for f in fields))
    other = row_digest(*((changed or {}).get(f, col(f)) for f in fields))
    leaves = docs.select(
        F.when(col(tree_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), col(tree_col).cast("string"))).alias("tree"),
        col(id_col).cast("long").alias("k"), col(id_col).cast("long").alias("id"), leaf.alias("digest"), F.when(other != leaf, other).alias("changed"),
    ).withColumn("tie", F.monotonically_increasing_id())
    leaves, parts = indexed(written(leaves, "merkle-leaves"), shape)
    nodes = build(leaves, parts, shape)
    subroots = nodes.where("root").select("tree", "size", F.col("level").alias("top"), F.col("digest").alias("subroot"))

    over = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("k"), F.col("subroot").alias("digest"), F.lit(0).alias("tie"))
    over, over_parts = indexed(written(over, "merkle-subroots"), shape)
    over_nodes = build(over, over_parts, shape)
    root = over_nodes.where("root").select("tree", "size", F.col("level").alias("top"), F.col("digest").alias("subroot"), F.col("digest").alias("root"), F.array().cast(_TAIL).alias("tail"))
    members, tails = _blocks(over.withColumns({"id": F.lit(None).cast("long"), "changed": F.col("k")}), over_nodes, root, shape.band)
    above = written(members.groupBy("tree", "block").cogroup(tails.groupBy("tree", "block")).applyInArrow(_paths(shape.band), f"tree string, root string, tail {_TAIL}"), "merkle-above")

    members, tails = _blocks(leaves, nodes, subroots.join(above, "tree"), shape.band)
    schema = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return members.groupBy("tree", "block").cogroup(tails.groupBy("tree", "block")).applyInArrow(_proved(shape.band), schema)

