"""The stages one by one, each held against what its operator says of its own input; and the registered SQL."""

import sys
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recordforge.llm.decontamination import find_contamination
from recordforge.llm.pii import find_pii
from recordforge.llm.quality import quality_rules
from recordforge.llm.registry import QUERIES, SQL
from recordforge.llm.store import written
from tests.llm.test_near_dup import classes
from tests.oracle import assert_same, connect


@pytest.fixture(scope="module")
def steps(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    odd = spark.createDataFrame([(900001, None, None, None, None), (900002, "", "en", "s", 0), (None, "word", "en", None, 4), (900003, "one two three " * 10, "en", "s", 1)], docs.schema)
    out = [written(docs.unionByName(odd).unionByName(docs.limit(3)), "test")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], sf001), name))
    return out


def ids(df):
    return sorted((r[0] for r in df.select("doc_id").collect()), key=repr)


def test_order_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "packing"]
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_each_stage_does_its_work(spark, sf001, steps):
    raw, good, unlike, clean, redacted, packed = steps
    assert ids(good) == ids(quality_rules(raw).where("kept")) and 0 < good.count() < raw.count()
    want = {c for _, _, c in classes([tuple(r) for r in good.select("doc_id", "text").collect()], 5)}
    assert ids(unlike) == sorted(want, key=repr)
    hit = {r[0] for r in find_contamination(unlike, spark.read.parquet(f"{sf001}/benchmark.parquet")).where(F.size("hits") > 0).collect()}
    assert ids(clean) == [i for i in ids(unlike) if i not in hit]
    spans = {r["doc_id"]: r["spans"] for r in find_pii(clean).collect()}
    before, after = ({r["doc_id"]: r for r in s.collect()} for s in (clean, redacted))
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert (r["text"] == before[i]["text"]) == (not spans[i]) and r["n_chars"] == (len(r["text"]) if spans[i] else before[i]["n_chars"])
    fill = defaultdict(int)
    for r in packed.collect():
        fill[r["sequence_id"]] += r["length"]
    assert set(ids(packed)) == set(ids(redacted)) and max(fill.values()) <= 1024


def test_columns_of_any_name(spark, sf001):
    """Stages keep columns with dots and with the names that operators use themselves, and an empty table."""
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    odd = docs.selectExpr("1 as `a.b`", "*", "2 as `row`", "3 as row_key", "4 as quality_features", "5 as id", "6 as `c0`").where("doc_id % 4 = 0")
    for table in (odd, odd.unionByName(odd.where("doc_id < 20")), odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, sf001)
            assert out.columns == odd.columns and [f.dataType for f in out.schema] == [f.dataType for f in odd.schema], name
            assert {tuple(r[k] for k in (0, 6, 7, 8, 9, 10)) for r in out.collect()} <= {(1, 2, 3, 4, 5, 6)}
        assert corpus_pipeline.STAGES[-1][1](spark, table, sf001).count() >= 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf001, name):
    assert_same(QUERIES[name](spark, sf001), connect(sf001), SQL[name])


def test_entry_works_without_the_corpus_tools(monkeypatch):
    import __spark_entry__

    for module in ("recordforge.llm.registry", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, module, None)
    left = __spark_entry__.queries()
    assert left and not any(n.startswith("op") or n == "pipeline" for n in left)
