"""Streams that keep state: jobs that time out by themselves, and batches that are finished exactly once."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from recordforge.sources.versions import Versioned

#: What a store of this state needs of the session.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

_JOB = "id string, status string, attempts int, was_reset boolean"


class _Jobs(StatefulProcessor):
    def __init__(self, after_ms: int, attempts: int):
        self.after_ms, self.most = after_ms, attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, attempts int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        status, attempts = self.job.get() if self.job.exists() else ("pending", 0)
        for r in sorted(rows, key=lambda r: (r["at"], r["event"])):
            if r["event"] == "claimed" and status == "pending" and attempts < self.most:
                status, attempts = "running", attempts + 1
            elif r["event"] == "ok" and status != "failed":
                status = "done"
            elif r["event"] == "error" and status == "running":
                status = "failed" if attempts >= self.most else "pending"
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if status == "running":
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.after_ms)
        self.job.update((status, attempts))
        yield Row(id=key[0], status=status, attempts=attempts, was_reset=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, attempts = self.job.get()
        if status == "running" and attempts < self.most:
            self.job.update(("pending", attempts))
            yield Row(id=key[0], status="pending", attempts=attempts, was_reset=True)

    def close(self) -> None:
        pass


def job_states(events: DataFrame, *, after: float = 600, attempts: int = 3) -> DataFrame:
    """Jobs as they change, from events (id, event, at): claimed, ok or error. For update mode with a RocksDB state store.

    A claim counts an attempt and starts a timer; a job that is still running ``after`` seconds later, by the clock, is
    pending again if it has attempts left, and else stays. An error makes it pending again, or failed once attempts are
    used up. After a restart timers go on with the first micro-batch, which is that of the next event. What a job doesn't await (a second claim, an error of one that isn't running) changes nothing.
    """
    keyed = events.select(F.col("id").cast("string").alias("id"), "event", "at").groupBy("id")
    return keyed.transformWithState(statefulProcessor=_Jobs(int(after * 1000), attempts), outputStructType=_JOB, outputMode="Update", timeMode="ProcessingTime")


#: Buckets of an outcome, each of which keeps a few examples.
BUCKETS = ("fully_fixed", "needs_review", "hours", "rating", "cover", "taxonomy")
EXAMPLES = 3
_PART = "batch_id string, shard int, done long, " + ", ".join(f"{b} long" for b in BUCKETS) + ", examples string"


class _Counts(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "business_id string", "n int")
        self.sums = handle.getValueState("sums", "text string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        sums = json.loads(self.sums.get()[0]) if self.sums.exists() else {"done": 0, "n": dict.fromkeys(BUCKETS, 0), "examples": {b: [] for b in BUCKETS}}
        for r in sorted(rows, key=lambda r: r["business_id"]):
            if self.seen.containsKey((r["business_id"],)):
                continue
            self.seen.updateValue((r["business_id"],), (1,))
            sums["done"] += 1
            for b in BUCKETS:
                if r[b]:
                    sums["n"][b] += 1
                    if len(sums["examples"][b]) < EXAMPLES:
                        sums["examples"][b].append(r["business_id"])
        self.sums.update((json.dumps(sums),))
        yield Row(batch_id=key[0], shard=key[1], done=sums["done"], **sums["n"], examples=json.dumps(sums["examples"]))

    def close(self) -> None:
        pass


def batch_counts(outcomes: DataFrame, *, shards: int = 8) -> DataFrame:
    """Counters of each batch's outcomes so far, in ``shards`` parts, so that a large batch isn't one task's: for update mode.

    outcomes: (batch_id, business_id) and a flag for each of BUCKETS. An outcome that comes again isn't counted again.
    """
    shard: Column = F.pmod(F.xxhash64("business_id"), F.lit(shards)).cast("int")
    flags = [F.coalesce(F.col(b), F.lit(False)).alias(b) for b in BUCKETS]
    keyed = outcomes.select(F.col("batch_id").cast("string").alias("batch_id"), shard.alias("shard"), F.col("business_id").cast("string").alias("business_id"), *flags).groupBy("batch_id", "shard")
    return keyed.transformWithState(statefulProcessor=_Counts(), outputStructType=_PART, outputMode="Update", timeMode="None")


def finished(parts: DataFrame, totals: DataFrame) -> DataFrame:
    """Batches all of whose outcomes are in: (batch_id, done, total, counts, examples), with up to three examples a bucket."""
    of = lambda b: F.slice(F.array_sort(F.flatten(F.collect_list(F.from_json("examples", "map<string,array<string>>")[b]))), 1, EXAMPLES)
    whole = parts.groupBy("batch_id").agg(F.sum("done").alias("done"), *(F.sum(b).alias(b) for b in BUCKETS), F.struct(*(of(b).alias(b) for b in BUCKETS)).alias("examples"))
    return whole.join(totals.select(F.col("batch_id").cast("string").alias("batch_id"), "total"), "batch_id").where(F.col("done") >= F.col("total"))


def finish_batches(counts: DataFrame, totals: DataFrame, parts: Versioned, finals: Versioned, notify: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Keep the counters of ``batch_counts`` in a table, and finish each batch once, when its last outcome is in.

    A micro-batch may be repeated after a failure, and outcomes may come late or again: parts are replaced by key, and a
    batch gets one row in ``finals`` however often it is found complete. ``notify`` gets the batches that this call has
    finished; if it fails they stay finished, as they do where it isn't there.
    """

    def write(found: DataFrame, _: int) -> None:
        parts.merge(found)
        done = finished(parts.read().join(found.select("batch_id").distinct(), "batch_id", "left_semi"), totals)
        before = finals.state()[0]
        now = finals.insert_missing(done)
        if now > before:
            notify(finals.read(now).join(finals.read(before).select("batch_id"), "batch_id", "left_anti"))

    return counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
