"""Two-valued predicates over columns that may be null: a null is never true and always "not true"."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_true(c: Column) -> Column:
    return c.eqNullSafe(F.lit(True))


def not_true(c: Column) -> Column:
    """Keeps rows in which the flag is false or missing."""
    return ~is_true(c)


def sure(c: Column) -> Column:
    """A condition whose null counts as false."""
    return F.coalesce(c, F.lit(False))


def blank(c: Column) -> Column:
    """Missing or empty; white space isn't empty."""
    return c.isNull() | (c == "")


def present(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def truthy(c: Column) -> Column:
    """A text that is neither missing nor empty, else null: for coalesce chains."""
    return F.when(present(c), c)


def first_truthy(*columns: Column) -> Column:
    return F.coalesce(*(truthy(c) for c in columns))


def tri_state(c: Column, wanted: bool | None) -> Column | None:
    """A filter that is off, wants a value, or wants none."""
    return None if wanted is None else present(c) if wanted else blank(c)


def every(*conditions: Column | None) -> Column:
    """All conditions that are given; true if there is none."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def some(*conditions: Column | None) -> Column:
    """Any of the conditions that are given; false if there is none."""
    return reduce(lambda a, b: a | b, [c for c in conditions if c is not None], F.lit(False))


def differs(a: Column, b: Column) -> Column:
    """Unequal, where two nulls are equal and a null differs from a value."""
    return ~a.eqNullSafe(b)


def fired(*checks: tuple[str, Column]) -> Column:
    """Names of the conditions that hold, in the order given."""
    return F.array_compact(F.array(*(F.when(sure(c), F.lit(name)) for name, c in checks))) if checks else F.array().cast("array<string>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it; keeps long expressions small."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def bind(rows: DataFrame, **values: Column) -> DataFrame:
    """Rows with further columns, or new values of columns, each of which is computed once, however often later ones name it.

    A plain projection isn't enough: the optimiser copies its expressions to all places that name them, and plans that name
    a parsed week or address a hundred times grow beyond what can be planned. A generator of one row stops that.
    """
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in values]
    return rows.select(*kept, F.inline(F.array(F.struct(*(v.alias(n) for n, v in values.items())))))


def over_tasks(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over as many tasks as a shuffle has, for work that costs far more than reading.

    Tasks follow a file's row groups otherwise, and a table whose rows lie in one group would be the work of one task.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
