"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Test strings are the word windows of benchmark items. For each length of test string there are three tables. The shift
table says, for a block of words, how far the search may move on when it meets that block; where it says 0 a test string
may end. The suffix and prefix blocks together then pick the test strings to try, and those are compared word by word
and byte by byte. Documents are neither shuffled nor grouped: each task searches its own rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordforge.llm.store import by_position, drop, written
from recordforge.llm.words import ALNUM, BASE, LOWER, U, Texts, chunks, mix, tidy, words

#: Words in a test string; an item with fewer words is one test string.
WINDOW = 10
#: Bytes of benchmark text that one set of tables holds. A larger benchmark is searched for in several passes.
BLOCK_BYTES = 16 << 20
#: Test strings of an item that a piece of it gives; a long item goes in several pieces.
PIECE = 4096
#: Words between the places where the search of one text is started.
STRIDE = 256

_RESULT = "n_words long, items array<string>, hits array<struct<start:long,end:long>>"


@dataclass
class Tables:
    """Test strings of one length. tests: one row of word hashes each; owners: (test, item) pairs sorted by test."""

    length: int
    block: int
    shift: np.ndarray
    keys: np.ndarray
    tests: np.ndarray
    texts: list[bytes]
    owner_first: np.ndarray
    owners: np.ndarray

    def place(self, code: np.ndarray) -> np.ndarray:
        return (code >> U(40)).astype(np.int64) & (len(self.shift) - 1)


def _block(hashes: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """A code of the ``size`` words that end at each of ``ends`` (inclusive)."""
    code = np.full(len(ends), U(size), dtype=np.uint64)
    for j in range(size - 1, -1, -1):
        code = (code ^ hashes[ends - j]) * BASE
    return mix(code)


def build_tables(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> tuple[list[str | None], list[Tables]]:
    """Tables for items (id, text); items without a word have no test string."""
    names = sorted({i for i, _ in items if i is not None}) + [None]
    index = {name: k for k, name in enumerate(names)}
    by_length: dict[int, dict[bytes, tuple[np.ndarray, bytes, set[int]]]] = {}
    for texts in chunks(pa.array([t for _, t in items], pa.string()), 1 << 62):
        w = words(texts, ALNUM, LOWER)
        folded = LOWER[texts.data].tobytes()
        for i in range(len(texts)):
            a, b = int(w.first[i]), int(w.first[i + 1])
            size = min(window, b - a)
            for s in range(a, b - size + 1) if size else ():
                hashes = w.hashes[s : s + size]
                text = b" ".join(folded[w.starts[k] : w.ends[k]] for k in range(s, s + size))
                by_length.setdefault(size, {}).setdefault(text, (hashes, text, set()))[2].add(index[items[i][0]])
    return names, [_tables(size, list(found.values())) for size, found in sorted(by_length.items())]


def _tables(length: int, found: list[tuple[np.ndarray, bytes, set[int]]]) -> Tables:
    block = 3 if length >= 6 else min(2, length)
    tests = np.stack([x[0] for x in found])
    n = len(tests)
    flat, row = tests.reshape(-1), np.arange(n) * length
    suffix, prefix = _block(flat, row + length - 1, block), _block(flat, row + block - 1, block)
    keys = mix(suffix ^ (prefix * BASE))
    order = np.argsort(keys, kind="stable")
    size = 1 << max(12, int(np.ceil(np.log2(n * length * 4 + 1))))
    t = Tables(length, block, np.full(size, length - block + 1, dtype=np.int32), keys[order], tests[order], [found[k][1] for k in order], np.empty(0), np.empty(0))
    for end in range(block - 1, length):
        np.minimum.at(t.shift, t.place(_block(flat, row + end, block)), length - 1 - end)
    owners = [sorted(found[k][2]) for k in order]
    t.owner_first = np.concatenate(([0], np.cumsum([len(x) for x in owners])))
    t.owners = np.concatenate([np.array(x, dtype=np.int64) for x in owners])
    return t


def _search(texts: Texts, t: Tables, w, folded: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All occurrences: the last word of each, and its test string."""
    lo, hi = w.first[:-1] + t.length - 1, w.first[1:]
    runs = np.maximum(0, -(-(hi - lo) // STRIDE))
    starts = np.repeat(lo, runs) + STRIDE * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
    stops = np.minimum(starts + STRIDE, np.repeat(hi, runs))
    found = []
    while len(starts):
        code = _block(w.hashes, starts, t.block)
        move = t.shift[t.place(code)]
        at = move == 0
        if at.any():
            ends, suffix = starts[at], code[at]
            key = mix(suffix ^ (_block(w.hashes, ends - t.length + t.block, t.block) * BASE))
            first = np.searchsorted(t.keys, key, side="left")
            count = np.searchsorted(t.keys, key, side="right") - first
            some = count > 0
            found.append((np.repeat(ends[some], count[some]), np.repeat(first[some] - np.cumsum(count[some]) + count[some], count[some]) + np.arange(count[some].sum())))
        starts = starts + np.maximum(move, 1)
        live = starts < stops
        starts, stops = starts[live], stops[live]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ends, test = (np.concatenate(x) for x in zip(*found, strict=True))
    equal = np.ones(len(ends), dtype=bool)
    for j in range(t.length):
        equal &= w.hashes[ends - t.length + 1 + j] == t.tests[test, j]
    ends, test = ends[equal], test[equal]
    same = [b" ".join(folded[w.starts[k] : w.ends[k]] for k in range(e - t.length + 1, e + 1)) == t.texts[p] for e, p in zip(ends.tolist(), test.tolist(), strict=True)]
    return ends[same], test[same]


def _ranges(hit: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)]


def _scan(texts: Texts, names: list[str | None], tables: list[Tables]) -> Iterator[tuple[int, list[str], list[dict]]]:
    """For each text: words, ids of items that occur, and ranges of words inside occurrences."""
    w = words(texts, ALNUM, LOWER)
    folded = LOWER[texts.data].tobytes()
    cover = np.zeros(len(w.starts) + 1, dtype=np.int64)
    pairs = [np.empty(0, np.int64)]
    for t in tables:
        ends, test = _search(texts, t, w, folded)
        np.add.at(cover, ends - t.length + 1, 1)
        np.add.at(cover, ends + 1, -1)
        count = t.owner_first[test + 1] - t.owner_first[test]
        owner = t.owners[np.repeat(t.owner_first[test] - np.cumsum(count) + count, count) + np.arange(count.sum())]
        pairs.append(np.unique(np.repeat(w.doc[ends], count) * len(names) + owner))
    doc, item = np.divmod(np.unique(np.concatenate(pairs)), len(names))
    items: dict[int, list[str]] = {}
    for d, i in zip(doc.tolist(), item.tolist(), strict=True):
        if names[i] is not None:
            items.setdefault(d, []).append(names[i])
    hit = np.cumsum(cover)[:-1] > 0
    touched = set(w.doc[hit].tolist())
    for i in range(len(texts)):
        a, b = int(w.first[i]), int(w.first[i + 1])
        yield b - a, items.get(i, []), _ranges(hit[a:b]) if i in touched else []


def _merge(a: list[dict], b: list[dict]) -> list[dict]:
    out: list[dict] = []
    for r in sorted([*a, *b], key=lambda r: (r["start"], r["end"])):
        if out and r["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], r["end"])
        else:
            out.append(dict(r))
    return out


def _piece_task(window: int):
    """Items in pieces that have all test strings between them: of PIECE test strings at most, and no test string is cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in chunks(batch.column("t")):
                w = words(texts, ALNUM, LOWER)
                at, pieces = [], []
                for i, (a, b) in enumerate(zip(w.first.tolist(), w.first[1:].tolist(), strict=False)):
                    for s in range(a, max(a + 1, b - window + 1), PIECE) if b > a else ():
                        at.append(texts.first + i)
                        pieces.append(texts.data[w.starts[s] : w.ends[min(s + PIECE + window - 1, b) - 1]].tobytes().decode())
                yield pa.RecordBatch.from_arrays([batch.column("i").take(pa.array(at, pa.int64())), pa.array(pieces, pa.string())], names=["i", "t"])

    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int, window: int) -> tuple[DataFrame, list[DataFrame]]:
    """The benchmark's distinct pieces in blocks of about ``block_bytes`` of text each; repeated rows and long items make no block larger."""
    named = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    pieces = written(named.where("t is not null").mapInArrow(_piece_task(window), "i string, t string").distinct(), "pieces")
    size = pieces.agg(F.coalesce(F.sum(F.octet_length("t") + F.coalesce(F.octet_length("i"), F.lit(0))), F.lit(0))).first()[0]
    n = max(1, -(-int(size) // block_bytes))
    return pieces, [pieces.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) for k in range(n)]


def _shared(part: DataFrame, window: int):
    return part.sparkSession.sparkContext.broadcast(build_tables([tuple(r) for r in part.collect()], window))


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Find the benchmark items that each document repeats.

    Returns one row for each row of ``docs``: its id, ``n_words``, ``items`` (ids of items with a test string in the
    text, as sorted strings) and ``hits`` (ranges of word positions inside occurrences, end exclusive).

    A null or empty text has no words and no hits. Items without words have no test strings; an item without an id marks
    words but is in no list; items that share an id count as one. Repeated documents each get their own row. An empty
    benchmark hits nothing. Other columns of either table are ignored.

    A very long document is handled alone, in time and memory that grow with its length; a very long item is cut into
    pieces that overlap. The benchmark is the only thing sent to all tasks. It goes in blocks of about ``block_bytes`` of
    text, whose number grows with the benchmark; each further block is one more pass over the documents.
    """
    pieces, parts = _blocks(benchmark, item_col, item_text_col, block_bytes, window)
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<string>").alias("items"), F.array().cast("array<struct<start:long,end:long>>").alias("hits"))
    state = T.StructType([T.StructField("id", out.schema["id"].dataType), T.StructField("text", T.StringType()), *T.StructType.fromDDL(_RESULT).fields])
    before: list = []
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        schema = T.StructType([f for f in state.fields if not (last and f.name == "text")])
        shared = _shared(part, window)
        out = out.mapInArrow(tidy(_task(shared, last, k > 0)), schema)
        if not last:
            out = _finished(out, shared, before)
    drop(pieces)
    return out.withColumnRenamed("id", id_col)


def _finished(out: DataFrame, shared, before: list[DataFrame]) -> DataFrame:
    """A pass's result, written, so that its block needn't be kept any longer, nor the result of the pass before it."""
    done = written(out, "decontamination")
    shared.destroy()
    drop(*before)
    before[:] = [done]
    return done


def _task(shared, last: bool, again: bool):
    hits_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, tables = shared.value
        for batch in batches:
            found = [x for texts in chunks(batch.column("text")) for x in _scan(texts, names, tables)]
            items, hits = [x[1] for x in found], [x[2] for x in found]
            if again:
                items = [sorted({*a, *b}) for a, b in zip(items, batch.column("items").to_pylist(), strict=True)]
                hits = [_merge(a, b) for a, b in zip(hits, batch.column("hits").to_pylist(), strict=True)]
            columns = {"id": batch.column("id")} | ({} if last else {"text": batch.column("text")})
            columns |= {"n_words": pa.array([x[0] for x in found], pa.int64()), "items": pa.array(items, pa.list_(pa.string())), "hits": pa.array(hits, hits_type)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in which ``find_contamination`` finds no hit, with all their columns.

    A null text stays; a very long one is searched whole. Repeated rows stay or go together; an empty table stays empty, and
    an empty benchmark drops nothing. Columns may have any names. Blocks are passed over one after the other, each over what
    the ones before it kept, so that one block's tables are in memory at a time.
    """
    names, docs = docs.columns, by_position(docs)
    text_col = f"c{names.index(text_col)}"
    out, before = docs, []
    pieces, parts = _blocks(benchmark, item_col, item_text_col, block_bytes, window)
    for k, part in enumerate(parts):
        shared = _shared(part, window)
        out = out.mapInArrow(tidy(_clean_task(shared, text_col)), docs.schema)
        if k < len(parts) - 1:
            out = _finished(out, shared, before)
    drop(pieces)
    return out.toDF(*names)


def _clean_task(shared, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, tables = shared.value
        for batch in batches:
            clean = [not hits for texts in chunks(batch.column(text_col)) for _, _, hits in _scan(texts, names, tables)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run


def contamination_report(found: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Counts and a digest of what ``find_contamination`` returned."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, h: s + h["end"] - h["start"])
    return found.select(id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))
