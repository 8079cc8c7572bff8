"""Licence notices planted in texts, and the alignment against its definition."""

import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import numpy as np

from recordforge.llm.licenses import STRETCH, TEMPLATES, _matches, _Template, find_licenses, patience_align


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 8), max_size=30), st.lists(st.integers(0, 8), max_size=30))
def test_alignment_is_a_common_subsequence(text, template):
    found = patience_align(text, template)
    assert all(text[i] == template[j] for i, j in found)
    assert all(a < c and b < d for (a, b), (c, d) in zip(found, found[1:], strict=False))


@given(st.lists(st.integers(0, 50), max_size=60))
def test_a_text_is_aligned_with_itself(words):
    assert patience_align(words, words) == [(k, k) for k in range(len(words))]


def test_each_template_is_found_whole_and_edited(spark):
    rows, want = [], {}
    for name, versions in TEMPLATES.items():
        for v in versions:
            words = v.split()
            rows.append((len(rows), "Some words of a text. " + v + " More words follow here."))
            want[len(rows) - 1] = name
            if len(words) >= 15:
                rows.append((len(rows), "intro " + " ".join([*words[:6], "inserted", *words[6:9], *words[10:]]).upper()))
                want[len(rows) - 1] = name
    clean = ["permission to use the software", None, "", "the the the of of to", "a license is granted " * 40, "word " * 20000]
    rows += [(1000 + k, t) for k, t in enumerate(clean)] + [(7, "a repeated id"), (None, TEMPLATES["MIT"][0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"licenses": F.lit("clash"), "n_words": F.lit(0)})
    got = find_licenses(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        names = {m["license"] for m in r["licenses"]}
        if r["doc_id"] in want and (r["doc_id"] != 7 or r["licenses"]):
            assert names == {want[r["doc_id"]]}
            assert all(5 * m["matched"] >= 4 * m["size"] and 0 <= m["start"] < m["end"] <= r["n_words"] for m in r["licenses"])
        if r["doc_id"] is not None and r["doc_id"] >= 1000:
            assert not names
        if r["doc_id"] is None:
            assert names == {"MIT"}


def test_two_notices_and_empty(spark):
    text = TEMPLATES["MIT"][1] + " filler words " * 60 + TEMPLATES["Apache-2.0"][0] + " then " + TEMPLATES["MIT"][1]
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = find_licenses(docs).first()["licenses"]
    assert [m["license"] for m in found] == ["MIT", "Apache-2.0", "MIT"] and all(m["matched"] == m["size"] for m in found)
    assert find_licenses(docs.limit(0)).count() == 0


def test_notices_within_prose(spark):
    """Exact notices are found whole, whatever words of the template stand around them."""
    prose = "the use of a copy is to be made in and for any person of the house by 4 or more and it is under the and of to a 0 that is not to be"
    prose = " ".join((prose + " and " + prose).split()[:40])
    rows, want = [], {}
    for name, versions in TEMPLATES.items():
        for v in versions:
            want[len(rows)] = name
            rows.append((len(rows), f"{prose} . {v} {prose}"))
    photo = len(rows)
    rows += [(photo, "Photo by A Smith, Oslo, 2020. Licensed under CC BY-NC 4.0."), (photo + 1, "Photo by A Smith, Oslo, 2020. Licensed under CC BY 4.0."), (photo + 2, " ".join([TEMPLATES["MIT"][1]] * 3))]
    got = {r["doc_id"]: r["licenses"] for r in find_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, name in want.items():
        assert [(m["license"], m["start"], m["end"] - m["start"], m["matched"]) for m in got[k]] == [(name, 40, got[k][0]["size"], got[k][0]["size"])]
    assert [[(m["license"], m["matched"], m["size"]) for m in got[photo + k]] for k in (0, 1)] == [[("CC-BY-NC-4.0", 7, 7)], [("CC-BY-4.0", 6, 6)]]
    assert [m["license"] for m in got[photo + 2]] == ["MIT"] * 3 and all(m["matched"] == m["size"] for m in got[photo + 2])


def _by_definition(text, template, need, lo, hi):
    """Every stretch is aligned: (start, end, aligned words) of the notices between two words of a text."""
    span = int(np.ceil(STRETCH * len(template)))

    def aligned(a):
        found = patience_align(text[a : min(a + span, hi)], template)
        return (len(found), found[0][0] - found[-1][0] - 1, -a - found[0][0]) if found else (0, 0, -a)

    out, at = [], lo
    while at < hi:
        if text[at] not in template or aligned(at)[0] < need:
            at += 1
            continue
        n, length, first = max(aligned(a) for a in range(at, min(at + span, hi)) if text[a] in template)
        out += [(-first, -first - length, n), *_by_definition(text, template, need, at, -first)]
        at = -first - length
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=80), st.lists(st.integers(0, 7), min_size=1, max_size=9), st.lists(st.tuples(st.integers(0, 80), st.integers(0, 9)), max_size=4))
def test_notices_are_those_of_all_stretches(text, template, planted):
    for at, cut in planted:
        text = [*text[:at], *template[: max(1, len(template) - cut % 3)], *text[at:]]
    t = _Template("x", np.array(template, dtype=np.uint64), 0.8)
    assert sorted(_matches(text, t)) == _by_definition(text, template, t.need, 0, len(text))


def test_a_notice_with_a_word_after_each_of_its_words(spark):
    text = "before " * 30 + " ".join(f"{w} zz{k}" for k, w in enumerate(TEMPLATES["MIT"][1].split())) + " after" * 30
    found = find_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["licenses"]
    assert [(m["license"], m["matched"] == m["size"]) for m in found] == [("MIT", True)]


def test_two_clauses_or_three(spark):
    two, three = TEMPLATES["BSD-2-Clause"][0], TEMPLATES["BSD-3-Clause"][1]
    got = find_licenses(spark.createDataFrame([(1, two), (2, three)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [[m["license"] for m in r["licenses"]] for r in got] == [["BSD-2-Clause"], ["BSD-3-Clause"]]


def test_many_notices_in_one_text_take_time_in_proportion():
    t = _Template("x", np.arange(40, dtype=np.uint64), 0.8)
    seconds = []
    for n in (1000, 4000):
        text = list(range(40)) * n
        began = time.perf_counter()
        assert len(list(_matches(text, t))) == n
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 12 * seconds[0] + 0.5
