"""MinHash near-duplicate classes by an LSH forest.

Texts with equal shingle sets become one node. Each node's MinHash signature is cut into one label per tree, and the
nodes are sorted by each tree's labels, then by the hashes that follow them, over the whole cluster. Candidates of a node
are its neighbours in those orders: the farther a neighbour lies in the order, the longer the prefix that both labels
must share, so that crowded regions are compared at a greater depth than sparse ones. Candidates are confirmed on the
full shingle sets.

A class of candidates can be too large for the reach of those orders. Where such a class fell into parts, its best linked
nodes are held against the nodes of the other parts, round after round until a round finds no link. That is cheap, and is
not what makes the links whole: what is then still in parts goes through an exact prefix-filter join, by which two sets
that are linked share one of their rarest shingles. It can also be asked for over all nodes, candidates or not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, count, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordforge.llm.components import connected_components, root_of
from recordforge.llm.store import by_position, drop, join_hot, written
from recordforge.llm.words import LOWER, NOT_SPACE, U, chunks, mix, tidy, windows, words

TREES = 16
DEPTH = 6
#: Neighbours up to this far apart in a sorted order must share a label prefix of this length.
REACH = ((4, 2), (8, 3), (16, 4))
#: Neighbours this near are always candidates; others only if their signatures don't already say "the same".
NEAREST, SAME = 2, 0.92
#: How far below the threshold the estimate of a candidate may lie: over 4 standard deviations of 96 hashes.
SLACK = 0.2
#: Nodes, and shingles of them, that a task keeps at hand while it confirms links within a candidate class.
KEPT_NODES, KEPT_SHINGLES = 64, 4_000_000
#: Nodes whose classes a task keeps in mind while it looks for candidates.
KEPT_ROOTS = 1_000_000
#: A candidate class of more nodes than one order's reach is crowded; in a round so many of its best linked nodes are held against the rest.
CROWDED, HUBS = 2 * REACH[-1][0], 8
#: Buckets (bits) in which shingles are counted, so that rare ones come first. Any order is right; this one is cheap.
BUCKET_BITS = 20
#: Buckets (bits) in which shingles that more than one part has are marked, so that most other rows aren't shuffled.
MARK_BITS = 22
#: A crowded class's nodes are dealt over so many keys where they meet what there is once for a class.
SALTS = 32
#: Nodes of a shingle are dealt over blocks of about this many, and held against each other block by block.
BLOCK = 512
#: Bits of a set's parity: two sets differ by at least as many shingles as their parities differ by bits.
PARITY = 512
#: Pairs that a task holds before it hands them on.
HELD_PAIRS = 500_000

_A = mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64)) | U(1)
_B = mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) + U(1 << 40))
#: Equal halves of two bytes, by their XOR.
_EQUAL = np.array([((x & 0xF0) == 0) + ((x & 0x0F) == 0) for x in range(256)], dtype=np.uint8)


def _sketch_task(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests = batch.column("id"), batch.column("digest")
            for texts in chunks(batch.column("text")):
                w = words(texts, NOT_SPACE, LOWER)
                runs, first = windows(w, shingle, short=True)
                full = np.flatnonzero(np.diff(first))
                signature = np.empty((len(full), len(_A)), dtype=">u4")
                for j in range(len(_A) if len(full) else 0):
                    signature[:, j] = np.minimum.reduceat(((runs ^ _B[j]) * _A[j]) >> U(32), first[full])
                size, key, own, parity = [0] * len(texts), [None] * len(texts), [None] * len(texts), [None] * len(texts)
                for row, i in enumerate(full.tolist()):
                    found = np.unique(runs[first[i] : first[i + 1]])
                    size[i], key[i], own[i] = len(found), hashlib.blake2b(found, digest_size=16).digest(), signature[row].tobytes()
                    parity[i] = np.packbits(np.bincount((found & U(PARITY - 1)).astype(np.int64), minlength=PARITY).astype(np.uint8) & 1).tobytes()
                yield pa.RecordBatch.from_arrays([ids.slice(texts.first, len(texts)), digests.slice(texts.first, len(texts)), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(own, pa.binary()), pa.array(parity, pa.binary())], names=["id", "digest", "n_shingles", "key", "signature", "parity"])

    return run


def _tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        raw = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype=np.uint8).reshape(n, TREES * DEPTH, 4)
        low = raw[:, :, 3] & 0x0F
        sketch = (low[:, 0::2] << 4) | low[:, 1::2]
        for t in range(TREES):
            label = raw[:, t * DEPTH : (t + 1) * DEPTH].reshape(n, -1)
            deeper = np.roll(sketch, -(t + 1) * DEPTH // 2, axis=1)  # from the hash after the label's on
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, t, np.int32)), pa.array([x.tobytes() for x in label], pa.binary()), pa.array([x.tobytes() for x in deeper], pa.binary()), batch.column("node"), batch.column("n_shingles")], names=["tree", "label", "sketch", "node", "n_shingles"]
            )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), width)


def _neighbours_task(threshold: int):
    """Candidates in a sorted stream of (tree, label, node): each row looks back at the rows before it.

    joins: whether a pair joins what the task's earlier pairs had left apart; these pairs alone have the same classes.
    """
    reach, half = REACH[-1][0], TREES * DEPTH // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, root = None, {}

        def joins(x: int, y: int) -> bool:
            x, y = root_of(root, x), root_of(root, y)
            root[max(x, y)] = min(x, y)
            return x != y

        for batch in batches:
            if not len(batch):
                continue
            own = (batch.column("tree").to_numpy(), _matrix(batch.column("label"), 4 * DEPTH).view(">u4"), batch.column("node").to_numpy(), batch.column("n_shingles").to_numpy(), _matrix(batch.column("sketch"), half))
            old = len(tail[0]) if tail else 0
            tree, label, node, size, sketch = (np.concatenate(x) for x in zip(tail, own, strict=True)) if tail else own
            tail = tuple(x[-reach:].copy() for x in (tree, label, node, size, sketch))
            n = len(node)
            same = np.cumprod(label[1:] == label[:-1], axis=1).sum(axis=1)
            common = np.concatenate(([0], np.where(tree[1:] == tree[:-1], same, 0)))  # with the row before
            least, a, b = np.full(n, DEPTH), [], []
            for far in range(1, min(reach, n - 1) + 1):
                least = np.minimum(least[1:], common[1 : n - far + 1])  # row i + far and row i
                need = next(d for r, d in REACH if far <= r)
                i = np.flatnonzero(least >= need)
                i = i[i + far >= old]
                j = i + far
                near = 100 * np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j])
                i, j = i[near], j[near]
                if not len(i):
                    continue
                agree = _EQUAL[sketch[i] ^ sketch[j]].sum(axis=1, dtype=np.int64) / (2 * half)
                estimate = (agree - 1 / 16) / (1 - 1 / 16)
                good = (estimate >= threshold / 100 - SLACK) & ((far <= NEAREST) | (estimate < SAME))
                a.append(node[i[good]])
                b.append(node[j[good]])
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
                if len(root) > KEPT_ROOTS:
                    root.clear()
                joined = [joins(x, y) for x, y in pairs.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.array(joined, pa.bool_())], names=["a", "b", "joins"])

    return run


def _sets(column: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    for texts in chunks(column):
        runs, first = windows(words(texts, NOT_SPACE, LOWER), shingle, short=True)
        for a, b in pairwise(first.tolist()):
            yield np.unique(runs[a:b])


def _linked(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    if 100 * min(len(x), len(y)) < threshold * max(len(x), len(y)):
        return False
    small, large = (x, y) if len(x) < len(y) else (y, x)
    at = np.searchsorted(large, small)
    both = int(np.count_nonzero(large[np.minimum(at, len(large) - 1)] == small))
    return 100 * both >= threshold * (len(x) + len(y) - both)


def _within_task(shingle: int, threshold: int):
    """Links in a stream sorted by candidate class: each node is held against those kept of its class that it isn't linked with yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[int, np.ndarray]] = []
        group: dict[int, int] = {}
        now = None
        for batch in batches:
            out: list[tuple[int, int]] = []
            for c, node, found in zip(batch.column("class").to_pylist(), batch.column("node").to_pylist(), _sets(batch.column("text"), shingle), strict=True):
                if c != now:
                    kept, group, now = [], {}, c
                group[node] = node
                for other, theirs in reversed(kept):
                    if group[other] != group[node] and _linked(found, theirs, threshold):
                        out.append((other, node))
                        gone, stays = group[node], group[other]
                        group = {k: stays if v == gone else v for k, v in group.items()}
                kept.append((node, found))
                while len(kept) > KEPT_NODES or len(kept) > 1 and sum(len(x) for _, x in kept) > KEPT_SHINGLES:
                    group.pop(kept.pop(0)[0])
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    return run


def _possible_task(threshold: int):
    """Pairs that their sets' sizes and parities don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, y = (_matrix(batch.column(c), PARITY // 8).view(np.uint64) for c in ("parity_a", "parity_b"))
            m, n = batch.column("size_a").to_numpy(), batch.column("size_b").to_numpy()
            good = 100 * np.minimum(m, n) >= threshold * np.maximum(m, n)
            good &= (100 + threshold) * np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= (100 - threshold) * (m + n)
            chosen = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([chosen.column(c) for c in ("a", "b", "part_a", "part_b")], names=["a", "b", "part_a", "part_b"])

    return run


def _pairs_task(shingle: int, threshold: int):
    """Pairs that are linked, but for those whose parts earlier links of the task have joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}
        for batch in batches:
            if len(root) > KEPT_ROOTS:
                root.clear()
            good = []
            parts = zip(batch.column("part_a").to_pylist(), batch.column("part_b").to_pylist(), strict=True)
            for (p, q), x, y in zip(parts, _sets(batch.column("text_a"), shingle), _sets(batch.column("text_b"), shingle), strict=True):
                p, q = root_of(root, p), root_of(root, q)
                good.append(p != q and _linked(x, y, threshold))
                if good[-1]:
                    root[max(p, q)] = min(p, q)
            chosen = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([chosen.column(c) for c in ("a", "b", "part_a", "part_b")], names=["a", "b", "part_a", "part_b"])

    return run


def _likely_task(threshold: int):
    """Pairs whose signatures don't rule a link out, with the share of hashes that agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, y = (_matrix(batch.column(c), 4 * TREES * DEPTH).view(">u4") for c in ("signature_a", "signature_b"))
            agree = (x == y).mean(axis=1)
            good = pa.array(agree >= threshold / 100 - SLACK, pa.bool_())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(good) for c in ("a", "b", "part_a", "part_b")), pa.array(agree).filter(good)], names=["a", "b", "part_a", "part_b", "agree"])

    return run


_PAIRS = "a long, b long, part_a long, part_b long"


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs, a written table, with their texts. Where they are few, they go to the texts and only theirs are shuffled."""
    keyed = pairs.withColumn("pair", F.monotonically_increasing_id())
    left, right = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")).join(keyed.select("pair", x), x).select("pair", f"text_{x}") for x in "ab")
    return keyed.join(left, "pair").join(right, "pair").select(*pairs.columns, "text_a", "text_b")


def _possible(pairs: DataFrame, nodes: DataFrame, threshold: int) -> DataFrame:
    """The pairs that may be linked by sizes and parities, without their texts."""
    for x in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"size_{x}"), F.col("parity").alias(f"parity_{x}")), x)
    return pairs.mapInArrow(_possible_task(threshold), _PAIRS)


def _crowd(classes: DataFrame, parts: DataFrame) -> DataFrame:
    """(class, node, part, salt) of all nodes of crowded classes that are in parts.

    A class can hold most nodes, so that its nodes are dealt over SALTS keys, and what there is once for a class is copied
    to each of them.
    """
    placed = classes.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    split = placed.groupBy("class").agg(F.count(F.lit(1)).alias("n"), (F.min("part") < F.max("part")).alias("split")).where(F.col("split") & (F.col("n") > CROWDED)).select("class")
    return written(placed.join(_copied(split), ["class", "salt"], "left_semi"), "crowd")


def _copied(of_class: DataFrame) -> DataFrame:
    return of_class.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))


def _hub_pairs(crowd: DataFrame, nodes: DataFrame, links: DataFrame, threshold: int, turn: int) -> DataFrame:
    """For each node of a crowd the likeliest pair with one of its class's best linked nodes in another part."""
    degree = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    best = crowd.join(degree, "node", "left").groupBy("class", F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(HUBS)).alias("k")).agg(F.max(F.struct(F.coalesce("degree", F.lit(0)), "node", "part")).alias("hub"))
    hubs = written(best.select("class", F.col("hub.node").alias("b"), F.col("hub.part").alias("part_b")), "hubs")
    signed = nodes.select("node", "signature")
    hubs = hubs.join(signed.withColumnsRenamed({"node": "b", "signature": "signature_b"}), "b")
    rest = crowd.join(signed.withColumnsRenamed({"signature": "signature_a"}), "node").withColumnsRenamed({"node": "a", "part": "part_a"})
    likely = rest.join(_copied(hubs), ["class", "salt"]).where("part_a <> part_b").select("a", "b", "part_a", "part_b", "signature_a", "signature_b").mapInArrow(_likely_task(threshold), f"{_PAIRS}, agree double")
    return likely.groupBy("a", "part_a").agg(F.max(F.struct("agree", "b", "part_b")).alias("x")).select("a", "x.b", "part_a", "x.part_b")


def _count_task(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for found in _sets(batch.column("text"), shingle):
                np.add.at(total, _bucket(found), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return run


def _bucket(found: np.ndarray) -> np.ndarray:
    return (found >> U(64 - BUCKET_BITS)).astype(np.int64)


def _prefix_task(shingle: int, threshold: int, counts):
    """The rarest shingles of each set, one of which any linked set of its group shares, with their places from the rarest on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = counts.value
        for batch in batches:
            rows: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64),) * 5]
            for group, node, part, found in zip(*(batch.column(c).to_pylist() for c in ("group", "node", "part")), _sets(batch.column("text"), shingle), strict=True):
                n, often = len(found), total[_bucket(found)]
                first = np.lexsort((found, often))[: n + threshold * -n // 100 + 1]
                place = np.flatnonzero(often[first] > 1)  # a shingle that is alone in its bucket is in no other set
                rows.append((mix(found[first[place]] ^ U(group)).view(np.int64), *(np.full(len(place), x, np.int64) for x in (node, part, n)), place))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows, strict=True)], names=["shingle", "node", "part", "size", "place"])

    return run


def _cells_task(threshold: int):
    """Pairs of different parts in a stream sorted by cell that their sizes, the places of their common shingle and their parities don't rule out.

    If a pair is linked, the bound by places holds at its first common shingle, as all others come later in both.
    """
    cell, rest = ("shingle", "low", "high"), ("block", "node", "part", "size", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in chain(batches, [None]):
            if batch is None:
                own = None
            elif len(batch):
                own = (*(batch.column(c).to_numpy() for c in (*cell, *rest)), _matrix(batch.column("parity"), PARITY // 8).view(np.uint64))
            else:
                continue
            if tail is None and own is None:
                return
            now = tail if own is None else own if tail is None else tuple(np.concatenate(x) for x in zip(tail, own, strict=True))
            shingle, low, high = now[:3]
            starts = np.flatnonzero(np.concatenate(([True], (shingle[1:] != shingle[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))))
            # The last cell may go on in the next batch.
            n = len(shingle) if own is None else int(starts[-1])
            tail = tuple(x[n:].copy() for x in now)
            _, low, high, block, node, part, size, place, parity = now
            end = np.concatenate((starts[1:], [len(shingle)]))[np.searchsorted(starts, np.arange(n), side="right") - 1]
            i, far, held, out = np.arange(n), 0, 0, []
            while len(i):
                far += 1
                i = i[end[i] > i + far]
                j = i + far
                both = size[i] + size[j]
                good = (part[i] != part[j]) & ((low[i] == high[i]) | (block[i] != block[j]))
                good &= 100 * np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j])
                good &= (100 + threshold) * np.minimum(size[i] - place[i], size[j] - place[j]) >= threshold * both
                a, b, both = i[good], j[good], both[good]
                differ = np.bitwise_count(parity[a] ^ parity[b]).sum(axis=1, dtype=np.int64)
                good = (100 + threshold) * differ <= (100 - threshold) * both
                a, b = a[good], b[good]
                turned = node[a] > node[b]
                a, b = np.where(turned, b, a), np.where(turned, a, b)
                out.append(np.stack((node[a], node[b], part[a], part[b]), axis=1))
                held += len(a)
                if held > HELD_PAIRS or not len(i):
                    pairs = np.unique(np.concatenate(out), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(x.copy()) for x in pairs.T], names=["a", "b", "part_a", "part_b"])
                    held, out = 0, []

    return run


def _missing_pairs(nodes: DataFrame, placed: DataFrame, shingle: int, threshold: int) -> tuple[DataFrame, list[DataFrame]]:
    """All pairs of nodes of one group but different parts that may be linked, and the tables that they are read from.

    placed: (group, node, part, text). None is left out: each step only drops what can't reach the threshold.
    """
    spark = nodes.sparkSession
    counted = placed.select("text").mapInArrow(_count_task(shingle), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(1 << BUCKET_BITS, np.int32)
    total[counted.column("bucket").to_numpy()] = np.minimum(counted.column("n").to_numpy(), np.iinfo(np.int32).max)
    rows = written(placed.mapInArrow(tidy(_prefix_task(shingle, threshold, spark.sparkContext.broadcast(total))), "shingle long, node long, part long, size long, place long"), "prefixes")
    # Within a task a shingle's rows are one, so that a shingle of very many nodes crowds nothing.
    met = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("p"), F.max("part").alias("q")).where("p < q")
    met = written(met.select("shingle", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "met")
    marked = met.select(F.shiftrightunsigned("shingle", 64 - MARK_BITS).alias("bucket")).distinct().toArrow()
    marks = np.zeros(1 << MARK_BITS, bool)
    marks[marked.column("bucket").to_numpy()] = True
    few = rows.mapInArrow(_marked_task(spark.sparkContext.broadcast(np.packbits(marks))), rows.schema)
    # The common shingles are few, at most one in BLOCK rows, so that they go to the rows and not the rows to them.
    shared = few.join(met.where("blocks = 1"), "shingle").unionByName(few.join(F.broadcast(met.where("blocks > 1")), "shingle"))
    blocked = shared.join(nodes.select("node", "parity"), "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    dealt = cells.repartition("shingle", "low", "high").sortWithinPartitions("shingle", "low", "high")
    return dealt.select("shingle", "low", "high", "block", "node", "part", "size", "place", "parity").mapInArrow(_cells_task(threshold), _PAIRS).distinct(), [rows, met]


def _marked_task(marks):
    """Rows whose shingle is in a marked bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(marks.value).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(known[(batch.column("shingle").to_numpy().view(np.uint64) >> U(64 - MARK_BITS)).astype(np.int64)]))

    return run


def near_duplicates(docs: DataFrame, *, shingle: int = 5, threshold: int = 80, everywhere: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents whose word shingle sets overlap.

    Words are split at white space, A-Z folded. Two documents are linked if ``100 * intersection >= threshold * union``
    on the sets of ``shingle``-word runs; a shorter text has one run of all its words. Returns one row for each row of
    ``docs``: its id, ``n_shingles``, ``component_id`` (the smallest id reachable over links, its own included) and
    ``kept`` (whether that is its own id).

    A null, empty or blank text has no shingles and is linked with nothing. Rows that share an id and a set stay as many
    rows of one class. A row without an id takes part in links, but only another's id can name its class; it is kept
    only if no row of its class has an id. An empty table gives an empty result. Other columns are ignored.

    No step groups a class in one task: equal sets meet in a partial aggregate, sorted orders are cut by rank, and a
    class is walked through in sorted order with a bounded number of sets at hand. Candidates beyond that reach are
    confirmed pair by pair, so that they only cost time, and what a crowded class still has in parts is joined exactly.
    So a link is missed only if none of the orders has its two texts, nor a chain of candidates between them, as
    candidates. With ``everywhere`` the exact join goes over all nodes and none is missed; its cost grows with the number of
    shingles that texts share by chance, which in prose grows faster than the corpus.

    A very long text is handled alone and whole, in memory that grows with its length.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("digest", F.xxhash64("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    sketches = written(rows.mapInArrow(tidy(_sketch_task(shingle)), f"id {id_type}, digest long, n_shingles long, key binary, signature binary, parity binary"), "sketches")
    nodes = written(sketches.where("key is not null").groupBy("key", "n_shingles", "signature", "parity").agg(F.min("id").alias("first_id"), F.coalesce(F.min_by("digest", "id"), F.min("digest")).alias("digest")).withColumn("node", F.monotonically_increasing_id()), "nodes")

    trees = nodes.select("node", "n_shingles", "signature").mapInArrow(_tree_rows, "tree int, label binary, sketch binary, node long, n_shingles long")
    order = ("tree", "label", "sketch", "node")
    ordered = trees.repartitionByRange(*order).sortWithinPartitions(*order)
    candidates = written(ordered.mapInArrow(tidy(_neighbours_task(threshold)), "a long, b long, joins boolean").groupBy("a", "b").agg(F.max("joins").alias("joins")), "candidates")
    components = connected_components(candidates.where("joins"))
    classes = components.withColumnRenamed("component", "class")

    # One text for each node: the one of its first id.
    chosen = nodes.join(classes, "node", "left").select("node", "class", "key", F.substring("signature", 1, 4 * DEPTH).alias("label"), F.col("first_id").alias("id"), "digest")
    texts = written(
        rows.join(chosen, (rows["digest"] == chosen["digest"]) & rows["id"].eqNullSafe(chosen["id"])).select("node", "class", "key", "label", "text").mapInArrow(tidy(_own_text(shingle)), "node long, class long, label binary, text string"),
        "texts",
    )
    walked = texts.where("class is not null").repartitionByRange("class", "label", "node").sortWithinPartitions("class", "label", "node").select("class", "node", "text")
    links = written(walked.mapInArrow(tidy(_within_task(shingle, threshold)), "a long, b long"), "links")
    parts = connected_components(links)

    spent = [candidates, components, texts]

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = written(_possible(pairs, nodes, threshold), "pairs")
        spent.append(pairs)
        found = _with_texts(pairs, texts).mapInArrow(tidy(_pairs_task(shingle, threshold)), _PAIRS)
        # One link of two parts joins them as well as many.
        return written(found.groupBy("part_a", "part_b").agg(F.min(F.struct("a", "b")).alias("link")).select("link.*"), "links")

    def joined(more: DataFrame) -> DataFrame:
        spent.append(parts)
        return connected_components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    # The best linked nodes of crowded classes, as long as holding nodes against them joins at least one in a hundred.
    for turn in count(1):
        crowd = _crowd(classes, parts)
        spent.append(crowd)
        n = crowd.count()
        if not n:
            break
        more = confirmed(_hub_pairs(crowd, nodes, links, threshold, turn))
        found = more.count()
        if found:
            links, parts = links.unionByName(more), joined(more)
        if 100 * found < n:
            break

    # Candidates that are still in different parts.
    left, right = (parts.select(F.col("node").alias(x), F.col("component").alias(f"part_{x}")) for x in "ab")
    apart = candidates.join(left, "a", "left").join(right, "b", "left").select("a", "b", F.coalesce("part_a", "a").alias("part_a"), F.coalesce("part_b", "b").alias("part_b")).where("part_a <> part_b")
    more = confirmed(apart)
    if not more.isEmpty():
        parts = joined(more)

    crowd = _crowd(classes, parts)
    spent.append(crowd)
    if everywhere:
        placed = texts.join(parts, "node", "left").select(F.lit(0).cast("long").alias("group"), "node", F.coalesce("component", "node").alias("part"), "text")
    else:
        placed = crowd.select(F.col("class").alias("group"), "node", "part").join(texts.select("node", "text"), "node").select("group", "node", "part", "text")
    if everywhere or not crowd.isEmpty():
        missing, tables = _missing_pairs(nodes, placed, shingle, threshold)
        more = confirmed(missing)
        drop(*tables)
        if not more.isEmpty():
            parts = joined(more)

    of_node = written(nodes.select("node", "key", "first_id").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")), "components")
    least = of_node.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = join_hot(of_node, least, "component").select("key", "component_id")
    worded = join_hot(sketches.where("key is not null"), named, "key").select("id", "n_shingles", "component_id")
    out = worded.unionByName(sketches.where("key is null").select("id", "n_shingles", F.col("id").alias("component_id")))
    result = out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
    drop(*spent, nodes)
    return result


def drop_near_duplicates(docs: DataFrame, *, shingle: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of ``near_duplicates``, with all columns: that of the least id; rows without an id come last.

    Where ids are null or repeated, rows get keys of their own in a written copy of the table, so that of repeated rows
    one stays. Each row without words is a class of its own and stays; a very long text is hashed whole. An empty table stays
    empty. Columns may have any names.
    """
    names, docs = docs.columns, by_position(docs)
    id_col, text_col = (f"c{names.index(c)}" for c in (id_col, text_col))
    odd = docs.groupBy(F.col(id_col)).count().where(F.col("count") > 1).union(docs.where(F.col(id_col).isNull()).select(id_col, F.lit(1).cast("long")))
    if odd.isEmpty():
        keep = near_duplicates(docs, shingle=shingle, threshold=threshold, id_col=id_col, text_col=text_col).where("kept").select(id_col)
        return docs.join(keep.hint("shuffle_hash"), id_col, "left_semi").select(*docs.columns).toDF(*names)
    key = "row_key"
    keyed = written(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    classes = near_duplicates(keyed, shingle=shingle, threshold=threshold, id_col=key, text_col=text_col)
    named = classes.select(key, "component_id").join(keyed.select(key, F.col(id_col).alias("own_id")), key)
    keep = named.groupBy("component_id").agg(F.min(F.struct(F.col("own_id").isNull().alias("no_id"), "own_id", F.col(key).alias("k"))).alias("first")).select(F.col("first.k").alias(key))
    return keyed.join(keep, key, "left_semi").select(*docs.columns).toDF(*names)


def _own_text(shingle: int):
    """Keep rows whose text gives the node's own set (ids can repeat), once for each node in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, nodes = batch.column("key").to_pylist(), batch.column("node").to_pylist()
            keep = []
            for key, node, found in zip(keys, nodes, _sets(batch.column("text"), shingle), strict=True):
                good = node not in seen and hashlib.blake2b(found, digest_size=16).digest() == key
                seen.add(node) if good else None
                keep.append(good)
            chosen = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([chosen.column(x) for x in ("node", "class", "label", "text")], names=["node", "class", "label", "text"])

    return run
