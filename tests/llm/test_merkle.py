"""The manifest against one that is built whole, in lists."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from recordforge.llm.merkle import Shape, carry, count_at, hashed, manifest

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def path(tree, i):
    out = []
    for level in tree[:-1]:
        first = i - i % 3
        out.append((level[first:i], level[i + 1 : first + 3]))
        i //= 3
    return out


def whole(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees.append(levels([leaf(r, r["text"]) for r in by[s]]))
    top = levels([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            steps = path(trees[k], i) + path(top, k)
            odd = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
            at = leaf(r, r["text"].replace("\n", "") if odd and r["text"] is not None else r["text"])
            for before, behind in steps:
                at = h(*before, at, *behind)
            root = top[-1][0]
            out.append((r["doc_id"], leaf(r, r["text"]), trees[k][-1][0], root, h(*(d for b, a in steps for d in b + a)), at, at == root))
    return out


def said(spark, rows, parts=3, extra=False, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    if extra:
        df = df.withColumns({"tree": F.lit("x"), "digest": F.lit(1), "a.b": F.lit(2), "pos": F.lit(None)})
    odd = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return [tuple(r) for r in manifest(df, FIELDS, changed={"text": F.when(odd, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}, **kw).collect()]


def key(r):
    return tuple((x is not None, x) for x in r)


def same(spark, rows, **kw):
    assert sorted(said(spark, rows, **kw), key=key) == sorted(whole([dict(zip(["doc_id", "text", "lang", "source", "n_chars"], r, strict=True)) for r in rows]), key=key)


def rows_of(sizes):
    return [(1000 * k + i, f"line {i}\n{'more' * (i % 3)}\n", "en", f"s{k:02}", i) for k, n in enumerate(sizes) for i in range(n)]


@pytest.mark.parametrize("shape", [Shape(), Shape(slice_bits=1, merge=2, band=1), Shape(slice_bits=2, merge=2, band=2)])
def test_trees_of_many_sizes(spark, shape):
    same(spark, rows_of([1, 2, 3, 4, 8, 9, 10, 27, 28, 81, 0, 100]), shape=shape)


def test_nulls_repeats_long_texts_and_other_columns(spark):
    odd = [(None, None, None, None, None), (None, "a\n", None, "s", 1), (5, None, "en", None, 0), (5, "", "en", "", 0), (6, "x" * 300_000 + "\n", "de", "é😀", 7), (-3, "neg\n", "en", "s", -1)]
    same(spark, odd + [(9, "same\n", "en", "s", 4)] * 5 + odd[1:3], extra=True, shape=Shape(slice_bits=2, merge=2, band=2))


def test_empty_table_and_one_row(spark):
    assert said(spark, []) == []
    same(spark, [(4, "only\n", "en", "s", 5)])


def test_stack_of_slices_that_are_cut_anywhere():
    """However the leaves are cut, all nodes are made once, in a slice or in the merge."""
    for size in (1, 2, 5, 9, 27, 50):
        tree = levels([hashed(str(i)) for i in range(size)])
        want = {(lv, p): d for lv, nodes in enumerate(tree) for p, d in enumerate(nodes) if lv}
        assert [len(x) for x in tree] == [count_at(size, lv) for lv in range(len(tree))]
        for cut in range(size + 1):
            made, left = [], []
            for part in (range(cut), range(cut, size)):
                m, rest = carry(((0, i, tree[0][i]) for i in part), size)
                made, left = made + m, left + rest
            more, last = carry(iter(left), size)
            assert last == [(len(tree) - 1, 0, tree[-1][0])]
            found = [(lv, p) for lv, p, _ in made + more]
            assert len(found) == len(set(found)) and {(lv, p): d for lv, p, d in made + more} == want
