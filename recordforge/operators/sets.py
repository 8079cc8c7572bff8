"""Array columns as sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def union(a: Column, b: Column) -> Column:
    """Each element once, in the order first seen; a null array is empty."""
    return F.array_union(F.coalesce(a, F.array()), F.coalesce(b, F.array()))


def pull(a: Column, value: Column) -> Column:
    return F.filter(a, lambda x: ~x.eqNullSafe(value))


def push(a: Column, b: Column) -> Column:
    return F.concat(F.coalesce(a, F.array()), F.coalesce(b, F.array()))


def same_set(a: Column, b: Column) -> Column:
    """Equal but for the order."""
    return F.array_sort(a).eqNullSafe(F.array_sort(b))


def subset(a: Column, b: Column) -> Column:
    return F.coalesce(F.size(F.array_except(a, b)) == 0, F.lit(False))


def update_where(a: Column, field: str, value: Column, changes: dict[str, Column]) -> Column:
    """Elements whose field has the value get new fields; others stay."""

    def step(x: Column) -> Column:
        new = x
        for name, v in changes.items():
            new = new.withField(name, v)
        return F.when(x[field].eqNullSafe(value), new).otherwise(x)

    return F.transform(a, step)


def values_if_set(m: Column) -> Column:
    """The values of a map whose keys equal its values (an array written as an object), else null."""
    entries = F.map_entries(m)
    return F.when((F.size(entries) > 0) & F.forall(entries, lambda e: e["key"].eqNullSafe(e["value"])), F.map_values(m))
