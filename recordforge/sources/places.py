"""Reading places and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordforge.functions.contact import host, split_emails
from recordforge.functions.nulls import present

#: Column names under which place lists hold a place's id.
ID_NAMES = ("place_id", "placeId", "placeid", "Place ID", "id")


def check_box(south: float, north: float, west: float, east: float, *, widest: float = 5.0) -> None:
    """Refuse a box that is empty or wider than ``widest`` degrees."""
    if not (south < north and west < east):
        raise ValueError("the box is empty")
    if north - south > widest or east - west > widest:
        raise ValueError(f"the box is wider than {widest} degrees")


def scan_places(spark: SparkSession, path: str, south: float, north: float, west: float, east: float) -> DataFrame:
    """Places of an open dataset inside a box: its nested columns are pruned and the box reaches the file scan.

    Rows without a name or a finite point are dropped.
    """
    return places_of(spark.read.parquet(path), south, north, west, east)


def places_of(rows: DataFrame, south: float, north: float, west: float, east: float) -> DataFrame:
    """Flat places from nested ones inside a box; without a name or a finite point a row is dropped."""
    check_box(south, north, west, east)
    first = F.try_element_at("addresses", F.lit(1))
    out = rows.where(F.col("bbox.xmin").between(west, east) & F.col("bbox.ymin").between(south, north)).select(
        F.col("id").alias("source_id"), F.col("names.primary").alias("name"), F.col("categories.primary").alias("category"), F.col("confidence"), F.col("bbox.ymin").alias("lat"), F.col("bbox.xmin").alias("lng"),
        first["freeform"].alias("address"), first["locality"].alias("city"), first["region"].alias("state"), first["postcode"].alias("postal_code"), first["country"].alias("country"),
    )
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out.where(present(F.col("name")) & finite("lat") & finite("lng"))


def read_records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Listings from a JSON array or JSON lines; a record that can't be read is kept in ``_corrupt_record``."""
    reader = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    return (reader.schema(schema) if schema else reader).json(path)


def email_map(rows: DataFrame) -> DataFrame:
    """(key, emails) of a file of (url, emails) rows, under the URL and under its domain; the first row of a key counts."""
    found = rows.select(F.trim("url").alias("url"), split_emails(F.col("emails")).alias("emails"), F.monotonically_increasing_id().alias("_at")).where(F.size("emails") > 0)
    both = found.select(F.explode(F.array_compact(F.array("url", host(F.col("url"))))).alias("key"), "emails", "_at")
    return both.groupBy("key").agg(F.min_by("emails", "_at").alias("emails"))


def email_object(text: Column) -> Column:
    """The same from one JSON object of key to list or comma-separated text, as a map."""
    lists = F.from_json(text, "map<string,string>")
    many = lambda v: F.when(F.ltrim(v).startswith("["), F.from_json(v, "array<string>")).otherwise(split_emails(v))
    return F.transform_values(lists, lambda k, v: many(v))


def read_place_list(spark: SparkSession, path: str) -> DataFrame:
    """A place list, CSV or XLSX, with ``place_id``: of an id column, else of a URL, else the first cell that looks like one."""
    rows = read_sheet(spark, path) if path.lower().endswith(".xlsx") else spark.read.option("header", True).csv(path)
    return with_place_id(rows)


def with_place_id(rows: DataFrame) -> DataFrame:
    cells = [F.col(f"`{c}`") for c in rows.columns]
    named = [F.col(f"`{c}`") for c in ID_NAMES if c in rows.columns]
    looks = lambda c: F.when(c.rlike("^ChIJ[A-Za-z0-9_-]+$"), c)
    in_url = lambda c: F.nullif(F.regexp_extract(c, r"place_id[=:/](ChIJ[A-Za-z0-9_-]+)", 1), F.lit(""))
    found = F.coalesce(*map(looks, named), *map(in_url, cells), *map(looks, cells))
    return rows.select(*[c for c in rows.columns if c != "place_id"], found.alias("place_id"))


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _sheet_rows(data: bytes) -> list[list[str | None]]:
    """The cells of a workbook's first sheet as text."""
    import zipfile
    from io import BytesIO
    from xml.etree import ElementTree

    with zipfile.ZipFile(BytesIO(data)) as book:
        names = sorted(n for n in book.namelist() if n.startswith("xl/worksheets/sheet"))
        shared = [] if "xl/sharedStrings.xml" not in book.namelist() else ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        out = []
        for row in ElementTree.fromstring(book.read(names[0])).iter(f"{_SHEET}row") if names else ():
            cells: list[str | None] = []
            for cell in row.iter(f"{_SHEET}c"):
                column = 0
                for letter in (x for x in cell.get("r", "") if x.isalpha()):
                    column = 26 * column + ord(letter) - 64
                cells += [None] * (max(column, len(cells) + 1) - len(cells))
                value = cell.find(f"{_SHEET}v")
                said = "".join(t.text or "" for t in cell.iter(f"{_SHEET}t")) if cell.get("t") == "inlineStr" else None if value is None else value.text
                cells[-1] = shared[int(said)] if cell.get("t") == "s" and said is not None else said
            out.append(cells)
    return out


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of XLSX files as text columns, named by the first file's first row. A workbook is one task's: it is a list of places, not a table of data."""
    books = spark.read.format("binaryFile").load(path).orderBy("path")
    first = books.limit(1).select("content").first()
    header = [h or f"column_{k}" for k, h in enumerate(_sheet_rows(bytes(first[0]))[0])] if first else []

    def rows(batches):
        import pandas as pd

        for batch in batches:
            for data in batch["content"]:
                yield pd.DataFrame([(r + [None] * len(header))[: len(header)] for r in _sheet_rows(bytes(data))[1:]], columns=header, dtype="object")

    return books.select("content").mapInPandas(rows, ", ".join(f"`{h}` string" for h in header))
