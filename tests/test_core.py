"""Readers, streams, and core operators on nulls, ties, repeated rows and empty tables."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from recordforge.functions import geo
from recordforge.operators import aggregates, dedup, emails, matching, queue, ranking, repair, similar
from recordforge.sources import places, sinks
from recordforge.streaming import jobs


def test_reads_json_lines_arrays_and_broken_records(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"name": "A", "n": 1}, {"name": "B"}]))
    (tmp_path / "b.json").write_text('{"name": "C", "n": 3}')
    rows = places.read_records(spark, str(tmp_path), "name string, n int, _corrupt_record string").collect()
    assert sorted((r["name"], r["n"]) for r in rows) == [("A", 1), ("B", None), ("C", 3)]
    (tmp_path / "c.json").write_text("{broken")
    broken = [r for r in places.read_records(spark, str(tmp_path), "name string, n int, _corrupt_record string").collect() if r["_corrupt_record"]]
    assert len(broken) == 1


def _workbook(path, rows):
    shared = sorted({c for r in rows for c in r if c is not None and not c.isdigit()})
    cell = lambda c, at: "" if c is None else f'<c r="{at}"><v>{c}</v></c>' if c.isdigit() else f'<c r="{at}" t="s"><v>{shared.index(c)}</v></c>'
    body = "".join(f'<row r="{i}">' + "".join(cell(c, f"{chr(64 + j)}{i}") for j, c in enumerate(r, 1)) + "</row>" for i, r in enumerate(rows, 1))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
        book.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")


def test_place_lists_by_id_url_or_any_cell(spark, tmp_path):
    rows = [["Title", "Place ID", "Link", "Note"], ["a", "ChIJone", None, "1"], ["b", "bad", "https://m.example/?place_id=ChIJtwo", None], ["c", None, None, "ChIJthree"], ["d", None, None, None]]
    _workbook(tmp_path / "list.xlsx", rows)
    (tmp_path / "list.csv").write_text("\n".join(",".join(c or "" for c in r) for r in rows))
    want = [("a", "ChIJone"), ("b", "ChIJtwo"), ("c", "ChIJthree"), ("d", None)]
    for name in ("list.xlsx", "list.csv"):
        got = places.read_place_list(spark, str(tmp_path / name)).select("Title", "place_id").collect()
        assert sorted(tuple(r) for r in got) == want


def test_boxes_are_refused_and_points_checked(spark):
    for box in ((1, 1, 0, 1), (0, 6, 0, 1), (0, 1, 3, 2)):
        with pytest.raises(ValueError):
            places.check_box(*box)


def test_writes_json(spark, tmp_path):
    sinks.write_json(spark.range(3), str(tmp_path / "out"))
    assert sorted(r["id"] for r in spark.read.json(str(tmp_path / "out")).collect()) == [0, 1, 2]


def test_upsert_takes_the_last_write(spark):
    table = spark.createDataFrame([(1, "old", 0), (2, "old", 0), (None, "null", 0)], "k int, v string, at int")
    new = spark.createDataFrame([(1, "z first", 1), (1, "a last", 2), (3, "tie b", 5), (3, "tie a", 5), (None, "new null", 1)], "k int, v string, at int")
    got = sorted(((r["k"], r["v"]) for r in sinks.upsert(table, new, ["k"], order="at").collect()), key=repr)
    assert got == sorted([(1, "a last"), (2, "old"), (3, "tie b"), (None, "null"), (None, "new null")], key=repr)
    assert sinks.upsert(table, new.limit(0), ["k"]).count() == 3 and sinks.upsert(table.limit(0), new, ["k"], order="at").count() == 3


def test_survivors_with_ties_nulls_and_a_crowded_key(spark):
    rows = spark.createDataFrame([(5, "a", 1, None), (3, "a", 1, 7), (4, "a", 1, 7), (9, "b", 2, None), (8, "b", 2, None), (1, "c", 0, 1)], "id int, k string, s int, created int")
    got = {r["id"]: (r["is_survivor"], r["survivor_id"], r["group_size"]) for r in ranking.survivors(rows, "k", F.col("s")).collect()}
    assert got == {5: (False, 3, 3), 3: (True, 3, 3), 4: (False, 3, 3), 9: (False, 8, 2), 8: (True, 8, 2), 1: (True, 1, 1)}
    assert ranking.survivors(rows.limit(0), "k", F.col("s")).count() == 0


@pytest.mark.parametrize("n", [1, 7, 100, 2000])
def test_stride_sample_of_any_type(spark, n):
    rows = spark.range(1234).select(F.format_string("k%05d", F.col("id") * 7919 % 99991).alias("k"))
    order = sorted(r["k"] for r in rows.collect())
    want = order if n >= len(order) else sorted(order[i * len(order) // n] for i in range(n))
    assert sorted(r["k"] for r in ranking.stride_sample(rows.repartition(5), "k", n).collect()) == want
    assert ranking.stride_sample(rows.limit(0), "k", n).count() == 0


def test_near_pairs_without_points_and_near_a_pole(spark):
    schema = "id int, name string, lat double, lng double"
    a = spark.createDataFrame([(1, "Cafe", 0.0, 0.0), (2, "Cafe", None, 1.0), (3, "Cafe", 80.0, 10.0), (4, "Cafe", 40.0, -75.0)], schema)
    b = spark.createDataFrame([(11, "Cafe", 0.0, 0.0), (13, "Cafe", 80.0, 10.0025), (14, "Cafe", 40.0, -75.0005), (15, "Other", 40.0, -75.0)], schema)
    assert sorted((r["id"], r["known_id"]) for r in matching.near_existing(a, b).collect()) == [(3, 13), (4, 14)]
    assert matching.near_existing(a.limit(0), b).count() == 0 and matching.near_existing(a, b.limit(0)).count() == 0


def test_crowded_keys_give_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(matching, "CROWD", 5)
    rows = spark.range(60).selectExpr("id", "case when id < 40 then 'hot' when id < 50 then concat('k', id div 2) end k")
    got = matching.or_key_match(rows, rows, ["k"])
    assert got.count() == 40 * 39 + 10 and got.select("id", "other_id").distinct().count() == got.count()
    named = spark.range(30).selectExpr("id", "'b' block", "concat('name number ', id % 15) name")
    pairs = {(r["id"], r["other_id"]) for r in similar.fuzzy_pairs(named, "block", F.col("name"), least=1.0).collect()}
    assert pairs == {(k, k + 15) for k in range(15)}


def test_dedup_of_nothing_and_of_blank_keys(spark):
    rows = spark.createDataFrame([(1, " x ", 1), (2, "x", 2), (3, " ", 1), (4, None, 1)], "id int, place_id string, created int")
    assert sorted((r["id"], r["action"]) for r in dedup.plan(rows, "place_id", F.lit(0)).collect()) == [(1, "keep"), (2, "purge")]
    assert dedup.plan(rows.limit(0), "place_id", F.lit(0)).count() == 0


def test_audits_of_empty_tables(spark):
    schema = "id int, name string, address string, latitude double, longitude double, country string, country_code string, hours_status string, n_hours int, resolve_status string, status double, onward boolean, cover string, place_id string, industry string, categories array<string>, outlet_ids array<string>, outlets array<string>, activated array<string>, n_activated int, corrupt boolean, is_cvb boolean, is_crawler boolean"
    from recordforge.functions import hours

    rows = spark.createDataFrame([(1, *[None] * 21, True)], schema).withColumn("week", F.when(F.lit(False), hours.parse_glued_hours(F.lit(""))))
    one = repair.audit(rows).first()
    assert set(one["failed_before"]) == set(repair.CHECKS) - {"hours_encoding"} and one["plan"] == ["hours", "keys", "country_code"] and not one["ready"]
    assert repair.audit(rows.limit(0)).count() == 0 and repair.seed_audit(rows.limit(0)).count() == 0


def test_pages_without_addresses(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "https://a.example", ""), (3, "https://a.example", "<p>no mail</p>"), (4, None, "x@y.org"), (4, None, "x@y.org"), (5, "https://y.org", "<a HREF='mailto:a%20b'>x</a> <script>s@t.org")], "page_id int, url string, html string")
    got = sorted((r["page"], r["email"], r["site"]) for r in emails.page_emails(pages).collect())
    assert got == [(4, "x@y.org", None)]


def test_counts_of_empty_tables(spark):
    none = spark.createDataFrame([], "total long, published long, city string, migrated_to array<string>")
    assert aggregates.session_totals(none).first().asDict() == {"total": 0, "published": 0, "live": 0, "cities": 0, "staging": 0, "publish_rate": 0}


def test_streams_count_drain_and_resume(spark, tmp_path):
    schema = "id long, source_id long, status string, completed timestamp, value string"
    source = tmp_path / "in"
    rows = [(k, k % 4, "done" if k % 2 == 0 else "failed", f"2024-01-01 00:{k:02d}:00", f"v{k}") for k in range(40)]
    batch = spark.createDataFrame(rows, "id long, source_id long, status string, completed string, value string").withColumn("completed", F.to_timestamp("completed"))
    batch.write.parquet(str(source / "0"))
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(source))

    def all_of(df, mode, name):
        query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.table(name).collect()

    latest = all_of(jobs.latest_progress(stream(), ["source_id"], "value", "completed"), "complete", "latest")
    assert {r["source_id"]: r["value"] for r in latest} == {0: "v36", 1: "v37", 2: "v38", 3: "v39"}
    want = queue.latest(batch, ["source_id"], "value", "completed").collect()
    assert sorted(map(tuple, latest)) == sorted(map(tuple, want))
    windows = all_of(jobs.finished_per_window(stream()), "complete", "windows")
    assert sum(r["done"] for r in windows) == 20 and all(r["hourly"] == 4 * r["done"] for r in windows)
    assert sorted(r["source_id"] for r in all_of(jobs.drain_once(stream().where("status = 'done'"), ["source_id"]), "append", "drained")) == [0, 2]

    seen = []
    for _ in range(2):  # the second run finds nothing new
        jobs.consume(stream(), lambda df, n: seen.append((n, df.count())), str(tmp_path / "consumed")).awaitTermination()
    batch.limit(3).write.parquet(str(source / "1"))
    jobs.consume(stream(), lambda df, n: seen.append((n, df.count())), str(tmp_path / "consumed")).awaitTermination()
    assert seen == [(0, 40), (1, 3)]
