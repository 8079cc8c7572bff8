"""Packing token pieces into sequences by a grouping genetic algorithm.

Pieces are dealt into blocks of bounded size. On each block several islands evolve packings: a crossover injects whole
well-filled bins of one parent into the other, drops the bins that then hold an item twice, and puts displaced items
back by best fit, longest first. Islands run as separate tasks; after each round an island's best packing moves on to
its neighbour. Bins that stay less than full in the best packings are opened, and their items go into a further, much
smaller level that is dealt anew over all blocks.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordforge.llm.store import written
from recordforge.llm.tokens import encoder, read_tokenizer, text_runs
from recordforge.llm.words import tidy

CAPACITY = 1024
#: Items in a block, islands on a block, packings on an island, children in a round, rounds, levels.
BLOCK, ISLANDS, POPULATION, CHILDREN, ROUNDS, LEVELS = 2048, 2, 5, 12, 2, 6
#: A packing's worst bins are opened for the next level, down from this share of the capacity.
OPEN_BELOW = 0.97


def _piece_task(shared, end_id: int | None, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, data, digest = shared.value
        tokens = encoder(name, data, digest)
        tail = np.array([] if end_id is None else [end_id], dtype="<u4")
        for batch in batches:
            for lo, texts in text_runs(batch.column("text")):
                at, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, found in enumerate(tokens.ids(texts)):
                    whole = np.concatenate((found.astype("<u4"), tail))
                    cuts = [0, *range(len(whole) % capacity or min(len(whole), capacity), len(whole) + 1, capacity)] if len(whole) else []
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        own = whole[a:b]
                        at.append(lo + i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(own.tobytes()))
                        if with_ids:
                            ids.append(own.astype(np.int64))
                columns = [batch.column("id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int64()))] * with_ids, names=["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return run


def cut_pieces(docs: DataFrame, tokenizer: str, *, end_id: int | None = 2, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The token pieces of each document: (id, piece, start, length, ids_crc32[, ids]).

    A document's ids are its text's and then ``end_id``. One of more than ``capacity`` is cut into pieces of that length,
    of which the first may be shorter. A null text is empty; repeated rows are cut each; a very long text is encoded whole,
    in memory that grows with its length; an empty table gives no pieces.
    """
    spark = docs.sparkSession
    name, data = read_tokenizer(tokenizer)
    shared = spark.sparkContext.broadcast((name, data, f"{name} {zlib.crc32(data)} {len(data)}".encode()))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return rows.mapInArrow(tidy(_piece_task(shared, end_id, capacity, with_ids)), schema)


class _Packing:
    """Bins of item numbers, and an index of bins by free room for best fit."""

    def __init__(self, sizes: list[int], capacity: int) -> None:
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.room: list[int] = []
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.some = 0

    def _index(self, b: int) -> None:
        r = self.room[b]
        self.by_room[r].append(b)
        self.some |= 1 << r

    def add_bin(self, items: list[int]) -> None:
        self.bins.append(items)
        self.room.append(self.capacity - sum([self.sizes[i] for i in items]))
        self._index(len(self.bins) - 1)

    def best_fit(self, items: list[int]) -> _Packing:
        """Put each item where it leaves least room, or in a new bin."""
        sizes, room, by_room = self.sizes, self.room, self.by_room
        for i in items:
            size = sizes[i]
            fitting = self.some >> size
            if fitting:
                r = size + (fitting & -fitting).bit_length() - 1
                b = by_room[r].pop()
                if not by_room[r]:
                    self.some &= ~(1 << r)
                self.bins[b].append(i)
                room[b] = r - size
                self._index(b)
            else:
                self.add_bin([i])
        return self

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then bins as unlike each other as can be: the fuller the full ones, the better."""
        return -len(self.bins), sum([(self.capacity - r) ** 2 for r in self.room])

    def assignment(self) -> list[int]:
        out = [0] * len(self.sizes)
        for b, items in enumerate(self.bins):
            for i in items:
                out[i] = b
        return out


def _of(assignment: list[int], sizes: list[int], capacity: int) -> _Packing:
    p = _Packing(sizes, capacity)
    bins: dict[int, list[int]] = {}
    for i, b in enumerate(assignment):
        bins.setdefault(b, []).append(i)
    for items in bins.values():
        p.add_bin(items)
    return p


def _child(a: _Packing, b: _Packing, rnd: random.Random) -> _Packing:
    """a with some whole well-filled bins of b, without the bins that clash and a few of its worst; displaced items are best-fitted."""
    order = sorted(range(len(b.bins)), key=lambda k: b.room[k])
    good = order[: max(1, len(order) // 2)]
    chosen = rnd.sample(good, max(1, len(good) // rnd.choice((2, 3, 5))))
    taken = {i for k in chosen for i in b.bins[k]}
    out = _Packing(a.sizes, a.capacity)
    for k in chosen:
        out.add_bin(list(b.bins[k]))
    worst = set(sorted(range(len(a.bins)), key=lambda k: -a.room[k])[: rnd.randint(1, 4)])
    loose = []
    for k, items in enumerate(a.bins):
        if k not in worst and taken.isdisjoint(items):
            out.add_bin(list(items))
        else:
            loose += [i for i in items if i not in taken]
    loose.sort(key=lambda i: -a.sizes[i])
    return out.best_fit(loose)


def evolve(sizes: list[int], seeds: list[list[int]], capacity: int, rnd: random.Random, population: int = POPULATION, children: int = CHILDREN) -> list[list[int]]:
    """A round on one island: from packings ``seeds`` (none at first) to this round's packings, the best first.

    It ends early at the least conceivable number of bins.
    """
    least = -(-sum(sizes) // capacity)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    alive = [_of(s, sizes, capacity) for s in seeds]
    if not alive:
        alive = [_Packing(sizes, capacity).best_fit(order)]
        while len(alive[0].bins) > least and len(alive) < population:
            noise = 0.02 + 0.1 * rnd.random()
            alive.append(_Packing(sizes, capacity).best_fit(sorted(order, key=lambda i: -sizes[i] * (1 + noise * rnd.random()))))
    alive.sort(key=_Packing.fitness, reverse=True)
    for _ in range(children):
        if len(alive[0].bins) <= least or len(alive) < 2:
            break
        a, b = sorted(rnd.sample(range(len(alive)), 2))
        alive.append(_child(alive[a], alive[b], rnd) if rnd.random() < 0.7 else _child(alive[b], alive[a], rnd))
        alive.sort(key=_Packing.fitness, reverse=True)
        del alive[population:]
    return [p.assignment() for p in alive]


def _round_task(capacity: int, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rnd = random.Random(f"{r['block']} {r['island']} {turn}")
                seeds = [*r["seeds"], *([r["migrant"]] if r["migrant"] is not None else [])]
                found = evolve(r["sizes"], seeds, capacity, rnd)
                best = max(found[0], default=-1) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["block"]], pa.int64()), pa.array([r["island"]], pa.int32()), pa.array([best], pa.int64()), pa.array([best <= -(-sum(r["sizes"]) // capacity)], pa.bool_()), pa.array([found], pa.list_(pa.list_(pa.int32())))],
                    names=["block", "island", "n_bins", "done", "seeds"],
                )

    return run


_STATE = "block long, island int, n_bins long, done boolean, seeds array<array<int>>"


def _evolved(blocks: DataFrame, capacity: int, n_blocks: int) -> DataFrame:
    """The best packing found for each block: (block, bins), one bin number for each item."""
    tasks = max(1, min(n_blocks * ISLANDS, 4096))
    start = blocks.select("block", "sizes", F.explode(F.array(*(F.lit(i) for i in range(ISLANDS)))).alias("island")).withColumns({"seeds": F.array().cast("array<array<int>>"), "migrant": F.lit(None).cast("array<int>")})
    state = written(start.repartition(tasks, "block", "island").mapInArrow(_round_task(capacity, 0), _STATE), "islands")
    for turn in range(1, ROUNDS + 1):
        open_blocks = state.groupBy("block").agg(F.max("done").alias("done")).where("not done").select("block")
        if open_blocks.isEmpty():
            break
        elite = state.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.get("seeds", F.lit(0)).alias("migrant"))
        going = state.join(open_blocks, "block", "left_semi").join(elite, ["block", "island"]).join(blocks.select("block", "sizes"), "block").select("block", "island", "sizes", "seeds", "migrant")
        moved = going.repartition(tasks, "block", "island").mapInArrow(_round_task(capacity, turn), _STATE)
        state = written(moved.unionByName(state.join(open_blocks, "block", "left_anti")), "islands")
    return state.groupBy("block").agg(F.min_by(F.get("seeds", F.lit(0)), F.struct("n_bins", "island")).alias("bins"))


def _layout_task(capacity: int, level: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                bins: dict[int, list[int]] = {}
                for i, b in enumerate(r["bins"]):
                    bins.setdefault(b, []).append(i)
                item, sequence, offset, size, loose = [], [], [], [], []
                for b, members in bins.items():
                    at = 0
                    fill = sum(r["sizes"][i] for i in members)
                    for i in members:
                        item.append(r["items"][i])
                        sequence.append((level << 56) + (r["block"] << 20) + b)
                        offset.append(at)
                        size.append(r["sizes"][i])
                        loose.append(not last and fill < OPEN_BELOW * capacity)
                        at += r["sizes"][i]
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()), pa.array(size, pa.int64()), pa.array(loose, pa.bool_())], names=["item", "sequence_id", "offset", "length", "loose"])

    return run


def pack_items(items: DataFrame, *, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Pack (item, length) rows, unique items of length 1 to ``capacity``, into few bins: (item, sequence_id, offset).

    Full items get a bin of their own. The others are dealt by a hash of the item, so that no block depends on lengths, and
    a block holds about ``block`` of them, however many items there are. Equal lengths are told apart by their items. An
    empty table gives an empty result. Items with a null or a length out of range must not be given.
    """
    parts = [items.where(F.col("length") == capacity).select("item", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest = items.where(F.col("length") < capacity).select("item", "length")
    before = None
    for level in range(LEVELS):
        n = rest.count()
        if not n:
            break
        n_blocks = -(-n // block)
        last = n_blocks == 1 or level == LEVELS - 1 or (before is not None and n > 0.7 * before)
        dealt = rest.select((F.pmod(F.xxhash64("item", F.lit(level)), F.lit(n_blocks))).cast("long").alias("block"), F.struct("length", "item").alias("x"))
        grouped = dealt.groupBy("block").agg(F.sort_array(F.collect_list("x"), asc=False).alias("x"))
        blocks = written(grouped.select("block", F.transform("x", lambda x: x["item"]).alias("items"), F.transform("x", lambda x: x["length"].cast("int")).alias("sizes")), "blocks")
        placed = blocks.join(_evolved(blocks, capacity, n_blocks), "block").mapInArrow(_layout_task(capacity, level, last), "item long, sequence_id long, offset long, length long, loose boolean")
        placed = written(placed, "layout")
        parts.append(placed.where("not loose").select("item", "sequence_id", "offset"))
        if last:
            break
        rest, before = placed.where("loose").select("item", "length"), n
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, *, end_id: int | None = 2, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut documents into token pieces and pack these into as few sequences of at most ``capacity`` tokens as it can.

    Returns one row for each piece: its document's id, ``piece``, ``start``, ``length``, ``ids_crc32`` (of its ids as
    little-endian unsigned 32-bit integers), ``sequence_id``, ``offset`` (gapless from 0), and with ``with_ids`` also
    ``ids``.

    A null text is empty; a document's only id is then ``end_id``, and with neither text nor ``end_id`` it has no piece.
    Rows that share an id are packed as documents of their own. A very long text is encoded whole and then cut. An empty
    table gives an empty result. Other columns are ignored.
    """
    cut = cut_pieces(docs, tokenizer, end_id=end_id, capacity=capacity, with_ids=with_ids, id_col=id_col, text_col=text_col)
    pieces = written(cut.withColumn("item", F.monotonically_increasing_id()), "pieces")
    out = pieces.join(pack_items(pieces.select("item", "length"), capacity=capacity), "item")
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))
