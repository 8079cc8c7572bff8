"""Near-duplicate classes against all pairs of full sets."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from recordforge.llm import components
from recordforge.llm.components import connected_components
from recordforge.llm.near_dup import CROWDED, drop_near_duplicates, near_duplicates
from recordforge.llm.store import join_hot
from recordforge.llm.words import equal_spans, span_hashes


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + min(k, len(w))]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def classes(rows, k, threshold=80):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * min(len(x), len(y)) >= threshold * max(len(x), len(y)) and 100 * len(x & y) >= threshold * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for k_, (i, _) in enumerate(sets):
        least[root(k_)] = min(least.get(root(k_), i), i)
    return sorted((i, len(s), least[root(k_)]) for k_, (i, s) in enumerate(sets))


def edited(words, r, n):
    out = list(words)
    for p in r.sample(range(5, len(out) - 5), n):
        out[p] = f"x{r.randrange(10**9)}"
    return " ".join(out)


def rows_with_copies():
    r = random.Random(3)
    rows = []
    for _ in range(12):
        base = [f"w{r.randrange(5000)}" for _ in range(r.choice((30, 80, 300)))]
        rows += [" ".join(base)] * r.choice((1, 3)) + [edited(base, r, n) for n in (1, 1, 2, 3, 5)]
    rows += [None, "", " \n", "one", "One", "one two", "two words here", "a b c d", "A B C D", "word " * 400, "é " * 30, "x" * 9000]
    r.shuffle(rows)
    return list(enumerate(rows))


def test_all_links(spark):
    rows = rows_with_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit(1), "key": F.lit("x"), "component_id": F.lit(None).cast("long")})
    for k, everywhere in ((4, False), (5, False), (5, True)):
        got = near_duplicates(docs, shingle=k, everywhere=everywhere).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == classes(rows, k)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def thue_morse(n, flip=0, letters="ab"):
    """A string and its complement, which a polynomial modulo a power of 2 can't tell apart."""
    return "".join(letters[(bin(k).count("1") + flip) % 2] for k in range(n))


def test_words_that_polynomial_hashes_confuse(spark):
    rows = [(n + flip, " ".join(thue_morse(n, flip) + f"{tail}" for tail in "pqrst")) for n in (1024, 2048, 4096) for flip in (0, 1)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == classes(rows, 4)
    assert all(r["kept"] for r in got)


def test_hashes_are_of_the_bytes_alone():
    r = random.Random(1)
    spans = [thue_morse(n, f) for n in (512, 1024, 2048, 4096) for f in (0, 1)] + ["".join(r.choice("abc") for _ in range(r.choice((1, 3, 7, 8, 9, 16, 17, 900, 1024, 1025, 1032, 5000)))) for _ in range(400)]
    spans += spans[:60]
    sizes = np.array([len(x) for x in spans])
    data, ends = np.frombuffer("".join(spans).encode(), np.uint8), np.cumsum(sizes)
    found = span_hashes(data, ends - sizes, ends).tolist()
    assert len(set(found)) == len(set(spans)) == len(set(zip(spans, found, strict=True)))
    other = np.array([spans.index(x) for x in spans])
    assert equal_spans(data, ends - sizes, ends, other).all()
    assert equal_spans(data, ends - sizes, ends, np.zeros(len(spans), np.int64)).tolist() == [x == spans[0] for x in spans]


def test_hot_keys_are_joined_like_others(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id")).alias("k"), "id")
    one = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    want = sorted(tuple(r) for r in rows.join(one, "k").collect())
    assert sorted(tuple(r) for r in join_hot(rows, one, "k").collect()) == want and len(want) > 2000


def test_a_hub_whose_copies_are_only_linked_with_it(spark):
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    rows = [(7, " ".join(base))] + [(100 + k, edited(base, r, 4)) for k in range(20 * CROWDED)]
    want = classes(rows[:60], 4)
    assert len({c for _, _, c in want}) == 1
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()
    assert {x["component_id"] for x in got} == {7} and sum(x["kept"] for x in got) == 1


def test_one_of_each_class_stays(spark):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "only without an id"), (None, "only without an id"), (4, None), (4, None), (5, ""), (6, "g h i j k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row_key", F.lit("own"))
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, "only without an id"), (1, "a b c d e f"), (4, ""), (4, ""), (5, ""), (6, "g h i j k")]


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(none).count() == 0 and drop_near_duplicates(none).count() == 0


def test_components_over_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(components, "EDGES", 7)
    r = random.Random(9)
    edges = [(k, k + 1) for k in range(30)] + [(100 + r.randrange(40), 100 + r.randrange(40)) for _ in range(25)]
    parent = {}
    for a, b in edges:
        a, b = components.root_of(parent, a), components.root_of(parent, b)
        parent[max(a, b)] = min(a, b)
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {x: components.root_of(parent, x) for e in edges if e[0] != e[1] for x in e}


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(50, 60), (60, 50), (70, 70), (None, 1), (80, 90), (81, 90)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {k: 0 for k in range(41)} | {50: 50, 60: 50, 80: 80, 81: 80, 90: 80}


def test_many_texts_from_one_template(spark):
    """One crowded candidate class: texts of a template are about 0.7 alike, and each has one copy that is linked with it alone."""
    r = random.Random(11)
    template = [f"w{r.randrange(10**6)}" for _ in range(200)]
    rows = []
    for k in range(600):
        base = edited(template, r, 5).split()
        rows += [(2 * k, " ".join(base)), (2 * k + 1, edited(base, r, 5))]
    r.shuffle(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()
    want = linked_classes(rows, 4)
    assert 400 < len({c for _, _, c in want}) < 800
    assert sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == want


def linked_classes(rows, k, threshold=80):
    """The classes by all pairs, counted by a product of 0/1 rows."""
    sets = [shingles(t, k) for _, t in rows]
    number = {s: n for n, s in enumerate(set().union(*sets))}
    column = np.concatenate([[number[s] for s in x] for x in sets])
    size = np.array([len(x) for x in sets])
    common = np.bincount(column, minlength=len(number))[column] > 1
    row = np.repeat(np.arange(len(sets)), size)[common]
    _, column = np.unique(column[common], return_inverse=True)
    held = np.zeros((len(sets), column.max() + 1), np.float32)
    held[row, column] = 1
    both = np.rint(held @ held.T).astype(np.int64)
    linked = 100 * both >= threshold * (size[:, None] + size[None, :] - both)
    least = np.array([i for i, _ in rows])
    while True:
        lower = np.where(linked, least[None, :], least.max()).min(axis=1)
        if (lower == least).all():
            return sorted((i, int(n), int(c)) for (i, _), n, c in zip(rows, size, least, strict=True))
        least = lower


def test_batches_without_candidates(spark):
    """Rows that share a label but are too far apart to be candidates: a batch can have such rows alone."""
    r = random.Random(13)
    base = [f"w{r.randrange(10**6)}" for _ in range(60)]
    rows = rows_with_copies() + [(1000 + k, edited(base, r, 9)) for k in range(200)]
    of_batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(of_batch)
    spark.conf.set(of_batch, "3")
    try:
        got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()
    finally:
        spark.conf.set(of_batch, before)
    assert sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == classes(rows, 4)
