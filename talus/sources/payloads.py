"""Captured payloads as frames, and the sinks that reports are written to.

Fetching is not a matter of query plans; these readers take what a collector has stored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of a listing record; a missing one is the empty string.
FIELDS = ("source", "title", "company", "location", "date", "url", "id", "modality", "description", "search_query")


def records(rows: DataFrame) -> DataFrame:
    """rows with all fields of a listing record as non-null strings, and every other column in the map extras."""
    known = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in FIELDS]
    other = [c for c in rows.columns if c not in FIELDS]
    extras = F.map_from_entries(F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in other))) if other else F.create_map().cast("map<string,string>")
    return rows.select(*known, extras.alias("extras"))


def captured(spark: SparkSession, path: str) -> DataFrame:
    """Raw files as source (folder), url (file) and body."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("source"), F.col("path").alias("url"), F.col("content").cast("string").alias("body"))


def json_listing(payloads: DataFrame, root: str, element: str) -> DataFrame:
    """One row for each element of the array at root of each JSON body."""
    return payloads.select("source", "url", F.explode(F.from_json(F.get_json_object("body", root), f"array<{element}>")).alias("item")).select("source", "url", "item.*")


def xml_feed(payloads: DataFrame, tag: str, fields: Sequence[str]) -> DataFrame:
    """One row for each element of an XML body, its fields as text."""
    items = F.regexp_extract_all("body", F.lit(f"(?s)(<{tag}\\b.*?</{tag}>)"), F.lit(1))
    one = lambda f: F.coalesce(F.regexp_replace(F.xpath_string("item", F.lit(f"{tag}/{f}")), "^\\s+|\\s+$", ""), F.lit(""))
    return payloads.select("source", F.explode(items).alias("item")).select("source", *(one(f).alias(f) for f in fields))


def fail_soft_union(parts: Sequence[tuple[str, DataFrame | Exception]]) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """The union of the parts that were made, and (source, error) of the others."""
    good = [df for _, df in parts if isinstance(df, DataFrame)]
    out = None
    for df in good:
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out, [(name, str(e)) for name, e in parts if not isinstance(e, DataFrame)]


def csv_ready(rows: DataFrame) -> DataFrame:
    """Lists, maps and structs as JSON, the keys of maps sorted, so that a CSV can hold them."""
    ordered = lambda c, t: F.map_from_entries(F.array_sort(F.map_entries(c))) if t.startswith("map") else F.col(c)
    return rows.select(*(F.to_json(ordered(c, t)).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in rows.dtypes))


def write_views(rows: DataFrame, views: dict[str, Column], folder: str) -> None:
    """One CSV folder a view, with a header also where the view is empty."""
    for name, predicate in views.items():
        csv_ready(rows.where(predicate)).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def publish(rows: DataFrame, folder: str, day: str, run_id: str, expected: int) -> None:
    """Write a run below its day, after its rows were counted: a run of another number of rows, or of none, is refused.

    A run that is published again replaces itself, so a retry leaves no row twice.
    """
    n = rows.count()
    if n != expected or not n:
        raise ValueError(f"{n} rows where {expected} were expected")
    rows.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/day={day}/run_id={run_id}")
