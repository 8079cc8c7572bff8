"""Versioned tables of hash buckets: a write replaces only the buckets it touches, and becomes visible all at once.

A table is a folder. Each write puts the new files of its buckets into a folder of its own and then adds one small file, the
next version, which names the folder of each bucket. That file comes to be by a rename that fails if it exists: of two
writers on the same version one wins, and the other works on what the first has written or gives up. A write that fails
leaves files that no version names; older versions stay readable.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordforge.sources import sinks

BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Another writer was faster, or holds the lock."""


class _Files:
    """The file system that a path is on."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        conf = spark._jsc.hadoopConfiguration()
        self.fs = self.of(self.path).getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.makeQualified(self.of(self.path)).toUri(), conf)

    def of(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        at = self.of(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        at = self.of(f"{self.path}/{name}")
        stream = self.fs.open(at)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """A file that appears whole or not at all; Conflict if there is one of that name."""
        draft = self.of(f"{self.path}/_drafts/{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.jvm.java.lang.reflect.Array.newInstance(rename.NONE.getClass(), 1)
        options[0] = rename.NONE
        target = self.of(f"{self.path}/{name}")
        self.fs.mkdirs(target.getParent())
        try:
            self.context.rename(draft, target, options)
        except Exception as e:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" in str(e) or self.fs.exists(target):
                raise Conflict(f"{name} was written meanwhile") from e
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self.of(f"{self.path}/{name}"), True)


class Versioned:
    """A table at ``path`` whose rows lie in buckets by their ``keys``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), _Files(spark, path)

    @classmethod
    def create(cls, rows: DataFrame, path: str, keys: list[str], *, buckets: int = 64) -> Versioned:
        """A new table of ``rows``. Choose so many buckets that one of them is what a task can write."""
        table = cls(rows.sparkSession, path)
        table._commit(0, {"keys": keys, "buckets": buckets, "schema": rows.schema.json(), "folders": table._write(rows, keys, buckets), "note": "created"})
        return table

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.files.names("_versions") if n.endswith(".json"))

    def state(self, version: int | None = None) -> tuple[int, dict]:
        known = self.versions()
        if not known:
            raise FileNotFoundError(f"there is no table at {self.path}")
        version = known[-1] if version is None else version
        return version, json.loads(self.files.read(f"_versions/{version:010}.json"))

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.state(version)[1], None)

    def merge(self, new: DataFrame, *, order: str | None = None, retries: int = 3) -> int:
        """Upsert as ``sinks.upsert``; returns the version that holds it. Only buckets of new keys are read and written."""
        return self.rewrite(new, lambda stored, rows: sinks.upsert(stored, rows, self.state()[1]["keys"], order=order), note="merge", retries=retries)

    def insert_missing(self, new: DataFrame, *, retries: int = 3) -> int:
        """Rows whose keys the table lacks are added; stored ones stay as they are."""
        return self.rewrite(new, lambda stored, rows: stored.unionByName(sinks.insert_missing(stored, rows.select(*stored.columns), self.state()[1]["keys"])), note="insert", retries=retries)

    def update(self, computed: DataFrame, columns: list[str], *, retries: int = 3) -> int:
        """Some columns take the values computed for the same key (one column); rows without one stay."""
        return self.rewrite(computed, lambda stored, rows: sinks.replace_columns(stored, rows, columns, self.state()[1]["keys"][0]).select(*stored.columns), note="update", retries=retries)

    def delete(self, ids: DataFrame, *, retries: int = 3) -> int:
        """Rows with these keys go."""
        keys = self.state()[1]["keys"]
        return self.rewrite(ids, lambda stored, rows: stored.join(rows.select(*keys).distinct(), keys, "left_anti").select(*stored.columns), note="delete", retries=retries)

    def rewrite(self, new: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], *, note: str = "", retries: int = 3) -> int:
        """Put ``how(stored rows of the touched buckets, new)`` in place of these buckets.

        Whoever comes second works on the first one's version, ``retries`` times. Without new rows nothing is written.
        """
        for _ in range(retries + 1):
            version, state = self.state()
            keys, n = state["keys"], state["buckets"]
            touched = sorted(r[0] for r in new.select(_bucket(keys, n).alias("b")).distinct().collect())  # as many as there are buckets at most
            if not touched:
                return version
            folders = self._write(how(self._rows(state, touched), new), keys, n, touched)
            state["folders"] = {b: f for b, f in state["folders"].items() if int(b) not in touched} | folders
            try:
                self._commit(version + 1, state | {"note": note})
                return version + 1
            except Conflict:
                continue
        raise Conflict(f"{self.path} was changed {retries + 1} times while it was written to")

    @contextmanager
    def locked(self, owner: str) -> Iterator[Versioned]:
        """Hold the table against other holders while several of its parts are applied; Conflict if someone holds it."""
        self.files.create("_lock", owner)
        try:
            yield self
        finally:
            self.files.delete("_lock")

    def vacuum(self, keep: int = 2) -> int:
        """Delete versions but the last ``keep``, and folders that none of these name; no write may be on its way. Returns folders deleted."""
        known = self.versions()
        for v in known[:-keep]:
            self.files.delete(f"_versions/{v:010}.json")
        used = {f for v in known[-keep:] for f in self.state(v)[1]["folders"].values()}
        gone = [f for f in self.files.names("data") if f"data/{f}" not in used]
        for f in gone:
            self.files.delete(f"data/{f}")
        return len(gone)

    def _rows(self, state: dict, buckets: list[int] | None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(state["schema"]))
        wanted = [f"{self.path}/{f}/{BUCKET}={b}" for b, f in state["folders"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*wanted) if wanted else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, keys: list[str], n: int, touched: list[int] | None = None) -> dict[str, str]:
        """Write rows by bucket; returns the folder of each bucket that has rows."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn(BUCKET, _bucket(keys, n)).repartition(len(touched) if touched else n, BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        return {name.partition("=")[2]: folder for name in self.files.names(folder) if name.startswith(f"{BUCKET}=")}

    def _commit(self, version: int, state: dict) -> None:
        self.files.create(f"_versions/{version:010}.json", json.dumps(state))


def _bucket(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
