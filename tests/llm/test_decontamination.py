"""Contamination against a plain search for each window."""

import hashlib
import re

from pyspark.sql import functions as F

from recordforge.llm import decontamination
from recordforge.llm.decontamination import contamination_report, drop_contaminated, find_contamination

ITEM = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
BENCHMARK = [(1, ITEM), (2, "short item"), (3, None), (4, ""), (5, "--- !"), (2, "another short one"), (None, "nameless item text"), (10, "Überraschung für alle"), (6, ITEM)]
DOCS = [
    (1, "before " + ITEM.upper() + " after"), (2, "short, item; and short item"), (3, None), (4, ""), (5, "alpha beta gamma delta epsilon zeta eta theta iota"), (6, "a nameless ITEM text here"), (7, "überraschung Für alle, Überraschung für alle"),
    (8, ("filler " * 700) + ITEM + (" filler" * 700)), (9, "another shorter one"), (1, "a repeated id with a short item"), (None, "a short item without an id"), (11, "x" * 5000), (12, "shortitem"), (13, (ITEM + " ") * 50),
]


def word_list(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text):
    w, hit, items = word_list(text), set(), set()
    for item, t in BENCHMARK:
        b = word_list(t)
        k = min(10, len(b))
        for s in range(len(b) - k + 1 if k else 0):
            for i in range(len(w) - k + 1):
                if w[i : i + k] == b[s : s + k]:
                    hit |= set(range(i, i + k))
                    items |= {str(item)} if item is not None else set()
    return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)


def tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumns({"items": F.lit("clash"), "hits": F.lit(0), "id": F.lit(0)})
    return docs, spark.createDataFrame(BENCHMARK, "item_id long, text string").withColumn("id", F.lit(9))


def test_all_windows(spark):
    docs, benchmark = tables(spark)
    want = sorted(((i, *plain(t)) for i, t in DOCS), key=repr)
    for size in (16 << 20, 40):  # one block, and several passes
        assert sorted((tuple(r) for r in contamination_report(find_contamination(docs, benchmark, block_bytes=size)).collect()), key=repr) == want
        kept = drop_contaminated(docs, benchmark, block_bytes=size)
        assert kept.columns == docs.columns
        assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == sorted((i, t or "") for i, t in DOCS if not plain(t)[4])


def test_long_and_repeated_items_go_in_bounded_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE", 3)
    docs, benchmark = tables(spark)
    many = benchmark.unionByName(spark.range(500).select(F.lit(6).cast("long").alias("item_id"), F.lit(ITEM).alias("text"), F.col("id")))
    long_item = " ".join(f"w{k}" for k in range(200))
    many = many.unionByName(spark.createDataFrame([(77, long_item, 0)], many.schema))
    pieces, parts = decontamination._blocks(many, "item_id", "text", 200, 10)
    assert pieces.count() == pieces.distinct().count() < 90 and sum(p.count() for p in parts) == pieces.count()
    assert all(len(r["t"].split()) <= 12 for r in pieces.collect())
    more = docs.unionByName(spark.createDataFrame([(50, "x " + " ".join(f"W{k}" for k in range(97, 140)) + " y", "", 0, 0)], docs.schema))
    for size in (16 << 20, 300):
        got = {r["doc_id"]: r for r in contamination_report(find_contamination(more, many, block_bytes=size)).collect()}
        assert (got[50]["n_words"], got[50]["n_hit"], got[50]["n_items"]) == (45, 43, 1)
        assert got[8]["n_hit"] == plain(dict(DOCS)[8])[1]


def test_empty_tables(spark):
    docs, benchmark = tables(spark)
    assert find_contamination(docs.limit(0), benchmark).count() == 0
    assert drop_contaminated(docs, benchmark.limit(0)).count() == len(DOCS)
    assert not any(r["hits"] for r in find_contamination(docs, benchmark.limit(0)).collect())
