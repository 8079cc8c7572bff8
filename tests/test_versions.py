"""Versioned tables: what a write touches, what a failed or second writer leaves, and the apply step on top."""

import os

import pytest
from pyspark.sql import functions as F

from recordforge.plans import promotion
from recordforge.sources.versions import Conflict, Versioned


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.range(2000).select("id", F.concat(F.lit("n"), "id").alias("name"), (F.col("id") % 7).alias("v"))
    return Versioned.create(rows, str(tmp_path / "t"), ["id"], buckets=32)


def content(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_an_upsert_rewrites_only_its_buckets(spark, table):
    new = spark.createDataFrame([(5, "five", 1), (5000, "new", 2), (None, "no key", 3)], "id long, name string, v long")
    before = table.state()[1]["folders"]
    assert table.merge(new) == 1
    after = table.state()[1]["folders"]
    changed = {b for b in after if after[b] != before[b]}
    assert 1 <= len(changed) <= 3 and len(after) == 32
    got = {r["id"]: r["name"] for r in table.read().collect()}
    assert got[5] == "five" and got[5000] == "new" and got[None] == "no key" and got[6] == "n6" and len(got) == 2002
    assert table.read(0).count() == 2000 and table.read(0).where("id = 5").first()["name"] == "n5"


def test_a_failed_write_leaves_the_version(spark, table):
    def fails(stored, new):
        return stored.withColumn("v", F.raise_error(F.lit("no")).cast("long"))

    with pytest.raises(Exception, match="no"):
        table.rewrite(spark.range(3).selectExpr("id"), fails)
    assert table.versions() == [0] and table.read().count() == 2000
    assert table.delete(spark.range(3).selectExpr("id")) == 1 and table.read().count() == 1997
    everywhere = spark.createDataFrame([(k, "m", 0) for k in range(2000)], "id long, name string, v long")
    assert table.merge(everywhere) == 2 and table.vacuum(keep=1) >= 2 and table.versions() == [2] and table.read().count() == 2000


def test_the_second_writer_works_on_the_first_ones_version(spark, table):
    tries = []

    def slow(stored, new):
        if not tries:
            table.merge(spark.createDataFrame([(7, "first", 1)], "id long, name string, v long"))
        tries.append(1)
        return stored.withColumn("name", F.when(F.col("id") == 7, F.concat("name", F.lit("+second"))).otherwise(F.col("name")))

    assert table.rewrite(spark.range(7, 8), slow) == 2
    assert len(tries) == 2 and table.read().where("id = 7").first()["name"] == "first+second"
    tries.clear()
    with pytest.raises(Conflict):
        table.rewrite(spark.range(7, 8), slow, retries=0)


def test_update_insert_and_nothing(spark, table):
    assert table.update(spark.createDataFrame([(1, 70)], "id long, v long"), ["v"]) == 1
    assert table.insert_missing(spark.createDataFrame([(1, "x", 0), (-4, "y", 0)], "id long, name string, v long")) == 2
    got = {r["id"]: tuple(r) for r in table.read().collect()}
    assert got[1] == (1, "n1", 70) and got[-4] == (-4, "y", 0) and len(got) == 2001
    assert table.merge(table.read().limit(0)) == 2


def test_lock(table):
    with table.locked("a"):
        with pytest.raises(Conflict), table.locked("b"):
            pass
    with table.locked("c"):
        assert "_lock" in os.listdir(table.path)


def sync(spark, tmp_path, **kw):
    target = spark.createDataFrame([(1, "old", "x"), (2, "same", "y"), (9, "other", "z")], "id long, city string, industry string")
    tables = {
        "businesses": Versioned.create(target, str(tmp_path / "b"), ["id"], buckets=4), "wallets": Versioned.create(spark.createDataFrame([(2, 5, 100, "active")], "owner_id long, credits int, total_credits int, status string"), str(tmp_path / "w"), ["owner_id"], buckets=4),
        "markers": Versioned.create(spark.createDataFrame([(9, "v1")], "id long, version string"), str(tmp_path / "m"), ["id"], buckets=4), "units": Versioned.create(spark.createDataFrame([(1, 0, 0)], "parent_id long, physical long, mobile long"), str(tmp_path / "u"), ["parent_id"], buckets=4),
    }
    plan = {
        "patches": spark.createDataFrame([(1, "new", "x", ["city"])], "id long, city string, industry string, changed_fields array<string>"), "wallets": spark.createDataFrame([(1, 0, 100, "active"), (2, 0, 100, "active")], "owner_id long, credits int, total_credits int, status string"),
        "markers": spark.createDataFrame([(1, "v2"), (2, "v2")], "id long, version string"), "units": spark.createDataFrame([(1, 3, 1)], "parent_id long, physical long, mobile long"),
    }
    return tables, plan


def test_plans_are_applied_once_in_order_and_only_where_allowed(spark, tmp_path):
    tables, plan = sync(spark, tmp_path)
    dry = promotion.apply_sync(plan, tables, environment="staging")
    assert content(dry.select("table", "rows")) == [("businesses", 1), ("markers", 2), ("units", 1), ("wallets", 2)] and all(t.versions() == [0] for t in tables.values())
    with pytest.raises(PermissionError):
        promotion.apply_sync(plan, tables, environment="production", dry_run=False)
    with tables["markers"].locked("someone"), pytest.raises(Conflict):
        promotion.apply_sync(plan, tables, environment="staging", dry_run=False)
    for _ in range(2):  # a repeat changes nothing
        promotion.apply_sync(plan, tables, environment="staging", dry_run=False)
        assert content(tables["businesses"].read()) == [(1, "new", "x"), (2, "same", "y"), (9, "other", "z")]
        assert content(tables["wallets"].read()) == [(1, 0, 100, "active"), (2, 5, 100, "active")]
        assert content(tables["markers"].read()) == [(1, "v2"), (2, "v2"), (9, "v1")] and content(tables["units"].read()) == [(1, 3, 1)]
