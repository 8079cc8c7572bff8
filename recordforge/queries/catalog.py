"""The registry of queries, and the inputs that they share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one that all executors share; a local one only where ``spark.checkpoint.dir`` is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints"
    return f"{shared.rstrip('/')}/recordforge-queries/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: Business-like records from the customers, in SQL that Spark and DuckDB both read.
BIZ = """
select c_custkey id, c_name name, n_name city, r_name state, c_mktsegment industry,
  case when c_custkey % 13 = 0 then null when c_custkey % 7 = 0 then '' else concat('ChIJ', cast(c_custkey % 900 as varchar(20))) end place_id,
  case c_custkey % 5 when 0 then null when 1 then 'https://media.example/a.jpg' when 2 then 'https://lh3.googleusercontent.com/x' when 3 then 'https://media.example/Defaults/c.png' else concat('https://media.example/', c_name) end cover,
  case c_custkey % 3 when 0 then 'done' when 1 then 'no_hours' end hours_status, cast(c_custkey % 8 as int) n_hours, cast(c_custkey % 4 as int) n_categories,
  case c_custkey % 6 when 0 then '12 Main St' when 1 then 'The Opera House' when 2 then '5 Oak Ave, Raleigh, NC 27614, USA' when 3 then 'www.example.com' when 4 then '+1 501-804-9227' else '77 Sunset Blvd' end address,
  case c_custkey % 10 when 0 then 'United States' when 1 then 'France' end country,
  cast(20 + (c_custkey % 350) * 0.1 as double) lat, cast(-60 - (c_custkey % 700) * 0.1 as double) lng, c_acctbal > 0 is_active, cast(c_custkey % 5 as int) n_outlets,
  case c_custkey % 9 when 0 then false when 1 then true end match, case when c_custkey % 4 = 0 then 'a@b.com' when c_custkey % 4 = 1 then ' ' end email, case when c_custkey % 2 = 0 then 'website_scrape' end email_source,
  case c_custkey % 4 when 0 then true when 1 then false end is_seeded, case c_custkey % 11 when 0 then true end is_cvb, case c_custkey % 17 when 0 then true when 1 then false end is_crawler,
  case c_custkey % 19 when 0 then true when 1 then false end is_deleted, date_add_days(c_custkey % 400) created, c_acctbal balance
from {customer} c join {nation} n on c.c_nationkey = n.n_nationkey join {region} r on n.n_regionkey = r.r_regionkey
"""


def biz_sql() -> str:
    text = BIZ.replace("date_add_days(c_custkey % 400)", "case when c_custkey % 23 = 0 then null else timestamp '2024-01-01 00:00:00' + to_days(cast(c_custkey % 400 as int)) end")
    return text.format(customer="customer", nation="nation", region="region")


def biz(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = BIZ.replace("date_add_days(c_custkey % 400)", "case when c_custkey % 23 = 0 then null else timestamp '2024-01-01 00:00:00' + make_dt_interval(cast(c_custkey % 400 as int)) end")
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in ("customer", "nation", "region")})


#: Jobs from the events: status, attempts and times by the id, in SQL that both read.
JOBS = """
select event_id id, user_id business_id, event_type type, case event_id % 5 when 0 then 'pending' when 1 then 'running' when 2 then 'done' when 3 then 'failed' else 'pending' end status,
  cast(event_id % 4 as int) attempts, ts created, case when event_id % 5 in (1, 2, 3) then ts end claimed, case when event_id % 5 in (2, 3) then ts end completed, user_id * 1000 + event_id % 50 source_id
from {events}
"""
NOW = "2024-01-20 00:00:00"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(JOBS, events=table(spark, sf_dir, "events"))


def jobs_sql() -> str:
    return JOBS.format(events="events")


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def joined(c: Column | str) -> Column:
    """An array of texts as one text, for comparing."""
    return F.array_join(c, ",")


def values(columns: list[str], rows: list[tuple]) -> str:
    """SQL that gives fixed rows; text, whole numbers, floats, truth values and null."""

    def lit(x: object) -> str:
        if x is None:
            return "null"
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, float):
            return f"{x!r}::double"
        return f"{x}::bigint" if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"

    return f"select * from (values {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({', '.join(columns)})"
