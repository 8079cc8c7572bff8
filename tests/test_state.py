"""Streams with state: timeouts by the clock, restarts, and batches that end once."""

import time

import pytest

from recordforge.sources.versions import Versioned
from recordforge.streaming import state


@pytest.fixture
def rocks(spark):
    old = {k: spark.conf.get(k, None) for k in state.ROCKSDB}
    for k, v in state.ROCKSDB.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


EVENTS = "id string, event string, at long"
FLAGS = "batch_id string, business_id string, " + ", ".join(f"{b} boolean" for b in state.BUCKETS)


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(folder)


def test_a_stuck_job_comes_back_by_the_clock_and_after_a_restart(rocks, tmp_path):
    source, seen = str(tmp_path / "in"), []
    put(rocks, source, [("a", "claimed", 1), ("b", "claimed", 1), ("b", "ok", 2), ("c", "claimed", 1), ("c", "error", 2), ("d", "error", 1)], EVENTS)

    def run():
        stream = state.job_states(rocks.readStream.schema(EVENTS).json(source), after=3, attempts=2)
        return stream.writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()

    def until(row, query):
        end = time.time() + 90
        while row not in seen and time.time() < end and query.isActive:
            time.sleep(0.3)
        query.stop()
        assert row in seen, (seen, query.exception())

    until(("a", "running", 1, False), run())
    assert {("b", "done", 1, False), ("c", "pending", 1, False), ("d", "pending", 0, False)} <= set(seen)
    put(rocks, source, [("e", "claimed", 3)], EVENTS)
    until(("a", "pending", 1, True), run())  # the timer is part of the state that the restart found
    put(rocks, source, [("a", "claimed", 5), ("a", "error", 6), ("b", "error", 7)], EVENTS)
    until(("a", "failed", 2, False), run())
    assert ("b", "done", 1, False) in seen and not any(r[0] == "b" and r[3] for r in seen)


def test_batches_end_once(rocks, tmp_path):
    source, told = str(tmp_path / "in"), []
    totals = rocks.createDataFrame([("x", 5), ("y", 2)], "batch_id string, total long")
    parts = Versioned.create(rocks.createDataFrame([], state._PART), str(tmp_path / "parts"), ["batch_id", "shard"], buckets=4)
    empty = state.finished(rocks.createDataFrame([], state._PART), totals)
    finals = Versioned.create(empty, str(tmp_path / "finals"), ["batch_id"], buckets=2)

    def row(batch, business, *flags):
        return (batch, business, *(b in flags for b in state.BUCKETS))

    def run():
        counts = state.batch_counts(rocks.readStream.schema(FLAGS).json(source), shards=2)
        state.finish_batches(counts, totals, parts, finals, lambda df: told.extend(df.collect()), str(tmp_path / "c")).awaitTermination()

    put(rocks, source, [row("x", f"b{k}", "hours", "fully_fixed") for k in range(4)] + [row("x", "b0", "hours")], FLAGS)
    run()
    assert told == []
    put(rocks, source, [row("x", "b4", "needs_review"), row("x", "b1", "hours"), row("y", "q", "cover")], FLAGS)
    run()
    assert [(r["batch_id"], r["done"], r["fully_fixed"], r["needs_review"], r["hours"], len(r["examples"]["hours"]), r["examples"]["needs_review"]) for r in told] == [("x", 5, 4, 1, 4, 3, ["b4"])]
    put(rocks, source, [row("x", "b2", "hours"), row("x", "late", "hours"), row("y", "q", "cover")], FLAGS)
    run()
    assert len(told) == 1 and finals.read().count() == 1
    put(rocks, source, [row("y", "r")], FLAGS)
    run()
    assert [r["batch_id"] for r in told] == ["x", "y"] and sorted(r["batch_id"] for r in finals.read().collect()) == ["x", "y"]
