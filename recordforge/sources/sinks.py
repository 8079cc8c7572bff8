"""Writing records. Tables aren't changed in place: each function gives the rows that a table should hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_valid(rows: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Rows to append and rows to set aside; a condition that is null sets aside."""
    good = F.coalesce(valid, F.lit(False))
    return rows.where(good), rows.where(~good)


def upsert(table: DataFrame, new: DataFrame, keys: list[str], *, order: str | None = None) -> DataFrame:
    """New rows replace those of their key.

    Of several new rows of a key the last written counts: the one with the greatest ``order``, a time or number of the
    write. Equal ones, and all where no order is given, are told apart by their columns, so that the result doesn't
    depend on how rows are dealt. A row with a null key replaces nothing and is added.
    """
    columns = F.struct(*table.columns)
    last = new.groupBy(*keys).agg(F.max_by(columns, F.struct(F.col(order) if order else F.lit(0), columns)).alias("_r")).select("_r.*")
    return table.join(last.select(*keys), keys, "left_anti").select(*table.columns).unionByName(last)


def insert_missing(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append: keys that the table lacks, each once; a row with a null key is always appended."""
    null_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    keyed = new.where(~null_key).join(table.select(*keys), keys, "left_anti").dropDuplicates(keys)
    return keyed.select(*new.columns).unionByName(new.where(null_key))


def refresh(table: DataFrame, new: DataFrame, key: str, fresh: list[str]) -> DataFrame:
    """Upsert that takes some columns from the new row and keeps the others of a stored one."""
    a, b = table.alias("a"), new.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    pick = lambda c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")) if c in fresh or c == key else F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}"))
    return both.select(*(pick(c).alias(c) for c in table.columns))


def soft_delete(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    hit = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    return table.join(hit, key, "left").withColumn("is_deleted", F.coalesce("_hit", F.col("is_deleted"))).select(*table.columns)


def hard_delete(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return table.join(ids.select(key), key, "left_anti").select(*table.columns)


def create_unless_same(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append: those of which no stored row has the same keys, whatever the case; each once."""
    norm = lambda d: d.withColumns({f"_{k}": F.lower(F.trim(k)) for k in keys})
    names = [f"_{k}" for k in keys]
    return norm(new).join(norm(table).select(*names), names, "left_anti").dropDuplicates(names).select(*new.columns)


def seed_if_empty(table: DataFrame, seed: DataFrame) -> DataFrame:
    return seed if table.isEmpty() else seed.limit(0)


def replace_columns(table: DataFrame, computed: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """A table whose columns are those computed anew for the same key, with ``is_changed``; rows without a computed one stay.

    The computed rows are one plan that a table format merges or overwrites at once; there are no batches of updates.
    """
    new = computed.select(key, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_hit"))
    both = table.join(new, key, "left")
    hit = F.coalesce("_hit", F.lit(False))
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~F.col(f"_{c}").eqNullSafe(F.col(c))
    return both.withColumn("is_changed", hit & changed).withColumns({c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).select(*table.columns, "is_changed")


def retain(log: DataFrame, most: int, at: str = "at") -> DataFrame:
    """A log's newest ``most`` rows."""
    return log.orderBy(F.desc(at), F.desc("id")).limit(most)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def not_yet(rows: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that a ledger of finished keys lacks: how a run goes on where it stopped."""
    return rows.join(ledger.select(*keys), keys, "left_anti")
