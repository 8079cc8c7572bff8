"""Phrase collocations by hierarchical pair naming.

A phrase of k words is the pair of its first and its last k - 1 words. So each level counts pairs of adjacent ids of the
level before, keeps the frequent ones and gives them ids of their own, which then stand in the texts instead. The pair is
a phrase's pointer to its two parents: along them come the counts of its first and last parts, and along them goes back
which phrases a longer one covers.

Texts are cut into chunks once. A chunk is a sequence of small local numbers with a table of the global ids that they
stand for, so that no task needs more of the global tables than its own words. Counts of pairs are summed up by a task
before they are shuffled. What is frequent then goes to all tasks while that is a table of a checked size; a larger one is
joined with the chunks' own pairs. Words are told apart by content, pairs by both ids.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordforge.llm.store import drop, join_hot, written
from recordforge.llm.words import BASE, LOWER, U, chunks, equal_spans, mix, tidy, words

#: Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK = 16 << 20
#: Characters that end a piece, and those that end a word within it.
PIECE_ENDS, WORD_ENDS = b".,;:!?\x0a\x0b\x0c\x0d", b" \t"

IN_PIECE = np.ones(256, dtype=bool)
IN_PIECE[list(PIECE_ENDS)] = False
WORD = IN_PIECE.copy()
WORD[list(WORD_ENDS)] = False

#: Frequent words or pairs of a level that go to all tasks, and bytes of a word among them; more are joined.
SENT, SENT_BYTES = 1_000_000, 32

#: A chunk's number has so many bits for its place in the task.
PLACE_BITS = 20

_SEQUENCE = "chunk long, ids binary, sequence binary"
_CODEC = "zstd"


def packed(numbers: np.ndarray) -> bytes:
    """Numbers as compressed bytes, behind their type and size."""
    raw = np.ascontiguousarray(numbers)
    return f"{raw.dtype.str}{raw.nbytes}:".encode() + (pa.compress(raw.tobytes(), codec=_CODEC, asbytes=True) if raw.nbytes else b"")


def unpacked(data: bytes) -> np.ndarray:
    head, _, body = data.partition(b":")
    kind, size = np.dtype(head[:3].decode()), int(head[3:])
    return np.frombuffer(pa.decompress(body, decompressed_size=size, codec=_CODEC, asbytes=True) if size else b"", dtype=kind)


def _distinct(text: pa.Array, langs: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """A chunk's words: the sequence of their local numbers (-1 after each piece), and word and language of each local number.

    Texts are worked on a megabyte at a time, so that only distinct words and numbers are held for the whole chunk.
    """
    sequences, keys, said, spoken = [np.empty(0, np.int32)], [np.empty(0, np.uint64)], [], [np.empty(0, np.int64)]
    for texts in chunks(text):
        w = words(texts, WORD, LOWER)
        folded = LOWER[texts.data]
        lang = langs[texts.first : texts.first + len(texts)][w.doc]
        own, first, local = np.unique(mix(w.hashes ^ (lang.astype(np.uint64) + U(1)) * BASE), return_index=True, return_inverse=True)
        if not (equal_spans(folded, w.starts, w.ends, first[local]) & (lang == lang[first[local]])).all():
            return _distinct_by_content(text, langs)
        piece = np.searchsorted(np.flatnonzero(~IN_PIECE[texts.data]), w.starts)
        ends = np.flatnonzero((piece[1:] != piece[:-1]) | (w.doc[1:] != w.doc[:-1])) + 1
        sequences += [np.insert(local.astype(np.int32) + len(said), ends, -1), np.array([-1], np.int32)]
        data = folded.tobytes()
        said += [data[x:y] for x, y in zip(w.starts[first].tolist(), w.ends[first].tolist(), strict=True)]
        keys.append(own)
        spoken.append(lang[first])
    lang = np.concatenate(spoken)
    _, first, local = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    if any(said[k] != said[f] for k, f in enumerate(first[local].tolist())) or (lang != lang[first[local]]).any():
        return _distinct_by_content(text, langs)
    return np.append(local.astype(np.int32), np.int32(-1))[np.concatenate(sequences)], [said[k] for k in first.tolist()], lang[first]


def _distinct_by_content(text: pa.Array, langs: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The same without hashes, for a chunk in which two words have the same one."""
    seen: dict[tuple[int, bytes], int] = {}
    sequence = []
    for texts in chunks(text):
        folded = LOWER[texts.data].tobytes()
        for k in range(len(texts)):
            for piece in re.split(rb"[" + re.escape(PIECE_ENDS) + rb"]", folded[texts.offsets[k] : texts.offsets[k + 1]]):
                sequence += [seen.setdefault((int(langs[texts.first + k]), x), len(seen)) for x in re.findall(rb"[^" + re.escape(PIECE_ENDS + WORD_ENDS) + rb"]+", piece)] + [-1]
    return np.array(sequence, np.int32), [x for _, x in seen], np.array([k for k, _ in seen], np.int64)


def _chunks(limit: int):
    """Chunks of rows (lang, text) of about ``limit`` bytes: their sequence, distinct words joined by new lines, and each one's language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, place = TaskContext.get().partitionId(), 0

        def flush(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal place
            table = pa.Table.from_batches(rows).combine_chunks()
            names, text = table.column(0).combine_chunks().dictionary_encode(), table.column(1).combine_chunks()
            codes = names.indices.to_numpy(zero_copy_only=False)
            if place >> PLACE_BITS:
                raise ValueError(f"a task reads more than {1 << PLACE_BITS} chunks")
            sequence, said, lang = _distinct(text, codes)
            count = np.bincount(sequence[sequence >= 0], minlength=len(said))
            per_lang = np.bincount(lang, weights=count, minlength=len(names.dictionary)).astype(np.int64)
            yield pa.record_batch(
                {
                    "chunk": pa.array([task << PLACE_BITS | place], pa.int64()),
                    "names": pa.array([names.dictionary.to_pylist()], pa.list_(pa.string())),
                    "totals": pa.array([per_lang.tolist()], pa.list_(pa.int64())),
                    "words": pa.array([packed(np.frombuffer(b"\n".join(said), np.uint8))], pa.binary()),
                    "langs": pa.array([packed(lang.astype(np.int32))], pa.binary()),
                    "sequence": pa.array([packed(sequence)], pa.binary()),
                }
            )
            place += 1

        held, size = [], 0
        for batch in batches:
            # A batch is cut so that no more than a chunk's text is held beside the one that is worked on.
            for at in range(0, batch.num_rows, 256):
                held.append(batch.slice(at, 256))
                size += held[-1].column(1).nbytes
                if size >= limit:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each chunk: (chunk, local, lang, word, n)."""
    for batch in batches:
        for row in batch.to_pylist():
            langs, sequence = unpacked(row["langs"]), unpacked(row["sequence"])
            if len(langs):
                n = np.bincount(sequence[sequence >= 0], minlength=len(langs)).astype(np.int64)
                names = pa.array(row["names"], pa.string())
                said = pa.array(unpacked(row["words"]).tobytes().decode().split("\n"), pa.string())
                whole = pa.record_batch({"chunk": pa.array(np.full(len(langs), row["chunk"]), pa.int64()), "local": pa.array(np.arange(len(langs)), pa.int32()), "lang": names.take(pa.array(langs)), "word": said, "n": pa.array(n)})
                for at in range(0, len(langs), 1 << 16):
                    yield whole.slice(at, 1 << 16)


def _pairs(ids: np.ndarray, sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of adjacent local numbers, as first * len(ids) + second in ascending order; and where in the sequence each adjacent two are which (-1: no pair)."""
    ok = (sequence[:-1] >= 0) & (sequence[1:] >= 0)
    keys, local = np.unique(sequence[:-1][ok].astype(np.int64) * len(ids) + sequence[1:][ok], return_inverse=True)
    out = np.full(max(len(sequence) - 1, 0), -1, dtype=np.int32)
    out[ok] = local
    return keys, out


def _counted_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct pairs of each chunk: (chunk, local, a, b, n), with the global ids of both parts."""
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpacked(row["ids"])
            keys, sequence = _pairs(ids, unpacked(row["sequence"]))
            if len(keys):
                n = np.bincount(sequence[sequence >= 0], minlength=len(keys)).astype(np.int64)
                whole = pa.record_batch({"chunk": pa.array(np.full(len(keys), row["chunk"]), pa.int64()), "local": pa.array(np.arange(len(keys)), pa.int32()), "a": pa.array(ids[keys // len(ids)]), "b": pa.array(ids[keys % len(ids)]), "n": pa.array(n)})
                for at in range(0, len(keys), 1 << 16):
                    yield whole.slice(at, 1 << 16)


def _renamed(chunk: int, sequence: np.ndarray, found: pa.Table) -> pa.Table:
    """A chunk's sequence with only frequent numbers, counted anew; of several breaks in a row one is left."""
    local, ids = found.column("local").to_numpy(), found.column("id").to_numpy()
    order = np.argsort(local)
    local, ids = local[order], ids[order]
    new = np.full(int(sequence.max(initial=-1)) + 2, -1, dtype=np.int32)
    new[local] = np.arange(len(local), dtype=np.int32)
    named = new[sequence]
    gap = named < 0
    named = named[~(gap & np.concatenate(([True], gap[:-1])))]
    return pa.table({"chunk": pa.array([chunk], pa.int64()), "ids": pa.array([packed(ids.astype(np.int64))], pa.binary()), "sequence": pa.array([packed(named)], pa.binary())})


_NO_SEQUENCE = pa.table({"chunk": pa.array([], pa.int64()), "ids": pa.array([], pa.binary()), "sequence": pa.array([], pa.binary())})


def _rename(pairs: bool):
    def run(sequences: pa.Table, found: pa.Table) -> pa.Table:
        if not sequences.num_rows or not found.num_rows:
            return _NO_SEQUENCE
        row = sequences.to_pylist()[0]
        sequence = unpacked(row["sequence"])
        return _renamed(row["chunk"], _pairs(unpacked(row["ids"]), sequence)[1] if pairs else sequence, found)

    return run


def _rename_words(sent):
    """Chunks' sequences renamed by the frequent words, as (lang, new line, word), that were sent to all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids = pa.array(sent.value[0], pa.string()), sent.value[1]
        for batch in batches:
            for row in batch.to_pylist():
                langs = unpacked(row["langs"])
                if len(langs):
                    said = pa.array(unpacked(row["words"]).tobytes().decode().split("\n"), pa.string())
                    at = pc.fill_null(pc.index_in(pc.binary_join_element_wise(pa.array(row["names"], pa.string()).take(pa.array(langs)), said, "\n"), known), -1).to_numpy()
                    local = np.flatnonzero(at >= 0)
                    if len(local):
                        yield from _renamed(row["chunk"], unpacked(row["sequence"]), pa.table({"local": local.astype(np.int32), "id": ids[at[local]]})).to_batches()

    return run


def _first(cut: DataFrame, least: int, most: int) -> tuple[DataFrame, DataFrame]:
    """The frequent words (lang, word, f, id) of chunks, and the sequences of these."""
    cut = cut.select("chunk", "names", "words", "langs", "sequence")
    counted = cut.mapInArrow(tidy(_counted_words), "chunk long, local int, lang string, word string, n long")
    found = written(counted.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least).withColumn("id", F.monotonically_increasing_id()), "phrase-words")
    named = F.concat("lang", F.lit("\n"), "word")
    n, size = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(named)), F.lit(0))).first()
    if n <= most and size <= SENT_BYTES * most:
        table = found.select(named.alias("name"), "id").toArrow()
        sent = cut.sparkSession.sparkContext.broadcast((table.column("name").to_pylist(), table.column("id").to_numpy()))
        return found, written(cut.mapInArrow(tidy(_rename_words(sent)), _SEQUENCE), "phrase-sequences")
    own = counted.join(found.select("lang", "word", "id"), ["lang", "word"]).select("chunk", "local", "id")
    return found, written(cut.select("chunk", F.lit(None).cast("binary").alias("ids"), "sequence").groupBy("chunk").cogroup(own.groupBy("chunk")).applyInArrow(_rename(False), _SEQUENCE), "phrase-sequences")


class _Known:
    """Frequent pairs and their ids, to be looked up many at a time."""

    def __init__(self, a: np.ndarray, b: np.ndarray, ids: np.ndarray):
        self.firsts, x = np.unique(a, return_inverse=True)
        self.seconds, y = np.unique(b, return_inverse=True)
        codes = x * max(len(self.seconds), 1) + y
        order = np.argsort(codes)
        self.codes, self.ids = codes[order], ids[order]

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs are known, and their ids."""
        if not len(self.codes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        x, y = (np.minimum(np.searchsorted(known, v), len(known) - 1) for known, v in ((self.firsts, a), (self.seconds, b)))
        codes = x * len(self.seconds) + y
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        hit = np.flatnonzero((self.firsts[x] == a) & (self.seconds[y] == b) & (self.codes[at] == codes))
        return hit, self.ids[at[hit]]


def _rename_known(sent):
    """Sequences renamed by the frequent pairs that were sent to all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(*sent.value)
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpacked(row["ids"])
                keys, sequence = _pairs(ids, unpacked(row["sequence"]))
                if len(keys):
                    local, found = known.find(ids[keys // len(ids)], ids[keys % len(ids)])
                    if len(local):
                        yield from _renamed(row["chunk"], sequence, pa.table({"local": local.astype(np.int32), "id": found})).to_batches()

    return run


def _next(sequences: DataFrame, least: int, most: int) -> tuple[DataFrame, DataFrame]:
    """The frequent pairs (a, b, f, id) of sequences, and the sequences of these."""
    spark = sequences.sparkSession
    counted = sequences.mapInArrow(tidy(_counted_pairs), "chunk long, local int, a long, b long, n long")
    found = written(counted.groupBy("a", "b").agg(F.sum("n").alias("f")).where(F.col("f") >= least).withColumn("id", F.monotonically_increasing_id()), "phrase-pairs")
    if found.limit(most + 1).count() <= most:
        table = found.select("a", "b", "id").toArrow()
        sent = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("a", "b", "id")))
        return found, written(sequences.mapInArrow(tidy(_rename_known(sent)), _SEQUENCE), "phrase-sequences")
    own = counted.join(found.select("a", "b", "id"), ["a", "b"]).select("chunk", "local", "id")
    return found, written(sequences.groupBy("chunk").cogroup(own.groupBy("chunk")).applyInArrow(_rename(True), _SEQUENCE), "phrase-sequences")


def candidates(docs: DataFrame, longest: int = 5, least: int = 100, text_col: str = "text", lang_col: str = "lang", chunk: int = CHUNK, most: int = SENT) -> DataFrame:
    """Phrases of 2 to ``longest`` words that occur ``least`` times or more in a language: (lang, n, phrase, k, a, parts).

    n: all word occurrences of the language. parts: for each place to cut, the counts (l, r) of what is before and behind.
    Phrases all of whose occurrences lie in occurrences of one longer candidate aren't among them.
    """
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    cut = written(rows.mapInArrow(tidy(_chunks(chunk)), "chunk long, names array<string>, totals array<long>, words binary, langs binary, sequence binary"), "phrase-chunks")
    totals = written(cut.select(F.explode(F.arrays_zip("names", "totals")).alias("x")).groupBy(F.col("x.names").alias("lang")).agg(F.sum("x.totals").alias("n")), "phrase-totals")

    found, sequences = _first(cut, least, most)
    drop(cut)
    node = found.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.col("f").alias("a"), F.array().cast("array<long>").alias("before"), F.array().cast("array<long>").alias("behind"))
    levels = [written(node, "phrases")]
    for _ in range(2, longest + 1):
        before = sequences
        found, sequences = _next(before, least, most)
        drop(before)
        first, last = levels[-1].select([F.col(c).alias(f"a_{c}") for c in levels[-1].columns]), levels[-1].select([F.col(c).alias(f"b_{c}") for c in levels[-1].columns])
        both = found.join(first, F.col("a") == F.col("a_id")).join(last, F.col("b") == F.col("b_id"))
        node = both.select(
            "id", F.col("a_lang").alias("lang"), F.concat_ws(" ", "a_phrase", "b_last").alias("phrase"), F.col("b_last").alias("last"), F.col("f").alias("a"),
            F.concat("a_before", F.array("a_a")).alias("before"), F.concat(F.array("b_a"), "b_behind").alias("behind"),
            F.when(F.col("f") >= F.col("a_a"), F.col("a")).alias("covers_a"), F.when(F.col("f") >= F.col("b_a"), F.col("b")).alias("covers_b"),
        )
        levels.append(written(node, "phrases"))
    drop(sequences)

    kept = []
    for k in range(2, longest + 1):
        own = levels[k - 1]
        if k < longest:
            longer = levels[k]
            covered = longer.select(F.col("covers_a").alias("id")).union(longer.select(F.col("covers_b").alias("id"))).where("id is not null").distinct()
            own = own.join(covered, "id", "left_anti")
        kept.append(own.select("lang", "phrase", F.lit(k).alias("k"), "a", F.arrays_zip(F.col("before").alias("l"), F.col("behind").alias("r")).alias("parts")))
    return join_hot(reduce(DataFrame.unionAll, kept), totals, "lang")


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, top: int = 2000, text_col: str = "text", lang_col: str = "lang", chunk: int = CHUNK, most: int = SENT) -> DataFrame:
    """Each language's ``top`` phrases by score: (lang, rank, phrase, a, l, r, n, score).

    Cutting a phrase into two parts with counts l and r scores floor(1000 * a * n / (l * r)); the lowest score counts, of
    equal ones the first cut. Order: score and a descending, phrase ascending by bytes, so that there are no ties.

    A null language is ``und``; a null or empty text has no words. Very long texts are worked on whole, repeated rows count
    as often as they occur, and an empty table gives no rows. Other columns, whatever their names, have no part.
    """
    whole = lambda c: c.cast("decimal(38,0)")
    # Exact integers: both products fit 38 digits while counts are below 10 ** 17.
    score = lambda x: F.call_function("div", whole(F.col("a")) * whole(F.col("n")) * 1000, whole(x["l"]) * whole(x["r"]))
    found = candidates(docs, longest, least, text_col, lang_col, chunk, most)
    cuts = F.transform("parts", lambda x, i: F.struct(score(x).alias("score"), i.alias("i"), x["l"].alias("l"), x["r"].alias("r")))
    scored = found.withColumn("cut", F.array_min(cuts)).select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return scored.withColumn("rank", place).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
