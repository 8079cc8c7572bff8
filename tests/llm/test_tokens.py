"""Token counts and packing against the tokenizers' libraries."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from recordforge.llm import tokens
from recordforge.llm.packing import evolve, pack_documents, pack_items
from recordforge.llm.store import scratch
from recordforge.llm.token_counts import count_tokens
from recordforge.llm.tokens import Encoder, read_tokenizer
from tests.llm.test_near_dup import thue_morse

TEXTS = [
    None, "", " ", "  \n\n \t x", "it's we'll I'd 'tis '' 's", "a<|endoftext|>b", "<s></s><unk> ▁ x▁y", "Straße naïve 日本語 テキスト 😀😀", "x" * 3000, "12345 67890 1,234.5", "a\x00b\x01", " nbsp em 　wide", "ﬁ ① Å", "line\r\nline\n", "word " * 3000, "end  ", "' s'S'LL", "\t\ttabs\u0085next",
]


def data(name):
    return read_tokenizer(public_tokenizers.path(name))


@pytest.fixture(scope="module")
def texts(spark, sf001):
    return TEXTS + [r[0] for r in spark.read.parquet(f"{sf001}/documents.parquet").select("text").collect()]


def library(name):
    if name.endswith(".model"):
        import sentencepiece

        whole = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        return lambda t: whole.encode(t or "")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda t: whole.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_gives_the_library_ids(name, texts):
    encode, whole = Encoder(*data(name)), library(name)
    want = [whole(t) for t in texts]
    assert encode.counts([t or "" for t in texts]).tolist() == [len(x) for x in want]
    if name.endswith(".json"):
        assert [x.tolist() for x in encode.ids([t or "" for t in texts])] == want


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_units_that_hashes_confuse(name, monkeypatch):
    """Strings that a polynomial hash takes for one another, and a hash that takes all units for one."""
    whole = library(name)
    texts = [thue_morse(n, flip, letters) for letters in ("th", "xe", "ab") for n in (1024, 2048, 4096) for flip in (0, 1)]
    assert Encoder(*data(name)).counts(texts).tolist() == [len(whole(t)) for t in texts]
    monkeypatch.setattr(tokens, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    again = Encoder(*data(name))
    assert [x.tolist() for x in again.ids(["some words and more", *texts[:4], "words some"])] == [whole(t) for t in ["some words and more", *texts[:4], "words some"]]


def test_only_misses_are_encoded(spark, tmp_path):
    """Counts that a cache holds are taken from it, and each text that it lacks is encoded once, whatever the number of its rows."""
    path, cache = public_tokenizers.path("piece_bpe_32k.model"), scratch(spark, "test-cache")
    docs = spark.createDataFrame([(k, f"text number {k % 40}" if k % 3 else None) for k in range(300)], "doc_id long, text string")
    count_tokens(docs.where("doc_id < 10"), path, cache)
    stored = spark.read.parquet(cache)
    assert stored.count() == 7
    marked = scratch(spark, "test-cache")
    stored.withColumn("n_tokens", F.lit(-5).cast("long")).write.parquet(marked)
    got = {r["doc_id"]: r["n_tokens"] for r in count_tokens(docs, path, marked).collect()}
    known = {docs_text for k in range(10) for docs_text in [f"text number {k % 40}" if k % 3 else ""]}
    assert all((got[k] == -5) == ((f"text number {k % 40}" if k % 3 else "") in known) for k in range(300))
    assert spark.read.parquet(marked).where("n_tokens <> -5").count() == 41 - len(known)


def test_counts_and_cache(spark, texts):
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "no id"), (3, "repeated"), (3, "repeated")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"digest": F.lit("clash"), "n_tokens": F.lit(-1)})
    whole, cache = library("piece_bpe_32k.model"), scratch(spark, "test-cache")
    path = public_tokenizers.path("piece_bpe_32k.model")
    want = Counter((i, len((t or "").encode()), len(whole(t)), len(whole(t)) > 4096) for i, t in rows)
    first = count_tokens(docs.limit(len(rows) // 2), path, cache).count()
    stored = spark.read.parquet(cache).count()
    assert first == len(rows) // 2 and stored == len({t or "" for _, t in rows[: len(rows) // 2]})
    for _ in range(2):
        assert Counter(tuple(r) for r in count_tokens(docs, path, cache).collect()) == want
        assert spark.read.parquet(cache).count() == len({t or "" for _, t in rows})
    spark.read.parquet(cache).select(F.lit("another version").alias("version"), "digest", F.lit(0).cast("long").alias("n_tokens")).write.mode("append").parquet(cache)
    assert Counter(tuple(r) for r in count_tokens(docs, path, cache).collect()) == want
    assert count_tokens(docs.limit(0), path, scratch(spark, "test-cache")).count() == 0


def test_packing_round_trip(spark, texts):
    rows = list(enumerate(texts)) + [(3, "repeated"), (3, "repeated"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"item": F.lit(5), "length": F.lit("clash")})
    whole = library("byte_bpe_50k.json")
    got = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True).collect()
    want = Counter()
    for i, t in rows:
        ids = [*whole(t), 2]
        head = len(ids) % 1024 or 1024
        cuts = [0, *range(head, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        want.update((i, k, a, tuple(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter((r["doc_id"], r["piece"], r["start"], tuple(r["ids"])) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        places.sort()
        assert [a for a, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1]] and sum(n for _, n in places) <= 1024
    assert len(bins) <= -(-sum(r["length"] for r in got) // 1024) + 1
    assert pack_documents(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_packing_is_close_to_full(spark):
    r = np.random.default_rng(4)
    sizes = np.clip(r.lognormal(5.5, 1, 9000).astype(int) + 1, 1, 1024).tolist()
    items = spark.createDataFrame(list(enumerate(sizes)), "item long, length long")
    got = pack_items(items, block=1024).collect()
    fill = defaultdict(int)
    for x in got:
        fill[x["sequence_id"]] += sizes[x["item"]]
    assert sorted(x["item"] for x in got) == list(range(len(sizes))) and max(fill.values()) <= 1024
    assert len(fill) <= 1.01 * -(-sum(sizes) // 1024)


def test_crossover_never_loses_an_item():
    import random

    rnd = random.Random(2)
    sizes = [rnd.randint(200, 700) for _ in range(60)]
    first = evolve(sizes, [], 1024, rnd)
    later = evolve(sizes, first, 1024, rnd)
    assert max(later[0]) <= max(first[0])
    for packing in (*first, *later):
        fill = defaultdict(int)
        for size, b in zip(sizes, packing, strict=True):
            fill[b] += size
        assert len(packing) == len(sizes) and max(fill.values()) <= 1024
