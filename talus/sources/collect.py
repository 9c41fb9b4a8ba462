"""Collectors: one declarative specification for each shape of captured payload, from bodies to records with diagnostics.

Fetching stays outside of query plans: payloads (source, url, body) are what a fetcher stored. A collector says how records
stand in a body, which are kept, what makes two of them the same, and what the site itself declared.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import extract, tree
from ..functions.text import blank, once
from .payloads import FIELDS


@dataclass(frozen=True)
class Collector:
    """How one source's records stand in its bodies.

    items: the array<struct> of raw items of a body; fields: each record field of an item (others are empty); keep: which
    records count; key: fields that make two records the same; prefer: which of them stays (the first on a tie); declared: a
    pattern whose first group is the number of records that a body says there are in all; most: records kept of a source, or
    with per of each value of that field (an employer).
    """

    source: str
    items: Callable[[Column], Column]
    fields: Mapping[str, Callable[[Column], Column]]
    keep: Callable[[], Column] = field(default=lambda: F.lit(True))
    key: Sequence[str] = ("url",)
    prefer: Callable[[], Column] = field(default=lambda: F.lit(0))
    declared: str | None = None
    most: int | None = None
    per: str | None = None


def links(pattern: str, site: str = "") -> Callable[[Column], Column]:
    """Items (href, title): anchors whose target matches; targets are made absolute where the page is given; markup in
    titles goes."""

    def of(body: Column) -> Column:
        own = lambda n: F.filter(n, lambda x: (x["tag"] == "a") & F.coalesce(tree.attr(x, "href").rlike(pattern), F.lit(False)))
        target = lambda x: extract.absolute(tree.attr(x, "href"), F.lit(site)) if site else tree.attr(x, "href")
        return tree.over(body, lambda n: F.transform(own(n), lambda x: F.struct(target(x).alias("href"), tree.text_of(n, x["at"]).alias("title"))))

    return of


def table(body: Column) -> Column:
    """Items (cells): the rows of tables that have cells."""
    return F.transform(F.filter(extract.table_rows(body), lambda r: F.size(r) > 0), lambda r: F.struct(r.alias("cells")))


def cell(n: int) -> Callable[[Column], Column]:
    """The nth cell of a table's item, from 0; empty beyond its end."""
    return lambda x: F.coalesce(F.get(x["cells"], F.lit(n)), F.lit(""))


def blocks(separator: str, labels: Sequence[str]) -> Callable[[Column], Column]:
    """Items (a map of label to value) of labelled blocks of text; blocks without any label go."""
    stop = "|".join(f"(?:{x})" for x in (*labels, "$"))

    def of(body: Column) -> Column:
        value = lambda b, x: F.trim(F.regexp_extract(b, f"(?is)(?:{x})\\s*(.*?)\\s*(?={stop})", 1))
        parts = F.transform(F.split(blank(body), separator), lambda b: F.struct(F.create_map(*(c for x in labels for c in (F.lit(x), value(b, x)))).alias("values")))
        return F.filter(parts, lambda p: F.exists(F.map_values(p["values"]), lambda v: v != ""))

    return of


def value(label: str) -> Callable[[Column], Column]:
    return lambda x: x["values"][label]


def objects(root: str, schema: str) -> Callable[[Column], Column]:
    """Items: the objects of the array at root of a JSON body; none if the body is no such JSON."""
    return lambda body: F.coalesce(F.from_json(F.get_json_object(body, root), f"array<{schema}>"), F.array().cast(f"array<{schema}>"))


def elements(tag: str, names: Sequence[str]) -> Callable[[Column], Column]:
    """Items: the elements of an XML body with the texts of the children named."""
    text = lambda n, e, name: F.coalesce(tree.text_of(n, tree.first(tree.below(n, e["at"]), lambda x: F.lower(x["tag"]) == name.lower())["at"]), F.lit(""))
    each = lambda n: F.filter(n, lambda x: F.lower(x["tag"]) == tag.lower())
    return lambda body: once(tree.xml_nodes(body), lambda n: F.transform(each(n), lambda e: F.struct(*(text(n, e, name).alias(name) for name in names))))


def section(heading: str, inner: Callable[[Column], Column], level: str = "h2") -> Callable[[Column], Column]:
    """inner on the part of a body from a heading that matches to the next heading of its level."""
    return lambda body: inner(F.regexp_extract(blank(body), rf"(?is)<{level}\b[^>]*>(?:(?!</{level}>).)*(?:{heading})(?:(?!</{level}>).)*</{level}>(.*?)(?=<{level}\b|$)", 1))


def latest_year(inner: Callable[[Column], Column], level: str = "h2") -> Callable[[Column], Column]:
    """inner on the section whose heading has the greatest year; on nothing if no heading has one."""

    def of(body: Column) -> Column:
        parts = F.regexp_extract_all(blank(body), F.lit(rf"(?is)(<{level}\b[^>]*>(?:(?!</{level}>).)*\b[0-9]{{4}}\b.*?)(?=<{level}\b|$)"), F.lit(1))
        year = lambda p: F.regexp_extract(p, r"(?s)^<[^>]*>(?:(?!</).)*?\b([0-9]{4})\b", 1).cast("int")
        newest = F.array_max(F.transform(parts, year))
        return inner(F.array_join(F.filter(parts, lambda p: year(p) == newest), ""))

    return of


def one_or_other(first: Callable[[Column], Column], second: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """The items of the first way that finds any; both must give the same structs."""
    return lambda body: F.when(F.size(first(body)) > 0, first(body)).otherwise(second(body))


def collect(payloads: DataFrame, collector: Collector) -> tuple[DataFrame, DataFrame]:
    """(records, diagnostics) of one source's payloads.

    records: FIELDS as non-null strings, one for each key, at most most of them in the order of url and place in the body.
    diagnostics, one row: source, bodies, declared, parsed, kept, unique, truncated, complete (there are bodies, no fewer
    records than declared, and none cut off). No payload: no record, and an incomplete row of zeros.
    """
    own = payloads.where(F.col("source") == collector.source).select("url", "body")
    total = F.regexp_extract(blank(F.col("body")), collector.declared, 1).try_cast("long") if collector.declared else F.lit(None).cast("long")
    items = own.select(F.col("url").alias("_url"), F.posexplode(collector.items(F.col("body"))).alias("_at", "_item"))
    made = {f: collector.fields[f](F.col("_item")) if f in collector.fields else F.lit("") for f in FIELDS if f != "source"}
    rows = items.select("_url", "_at", F.lit(collector.source).alias("source"), *(F.coalesce(c.cast("string"), F.lit("")).alias(f) for f, c in made.items()))
    rows = rows.withColumn("_keep", F.coalesce(collector.keep(), F.lit(False)))
    best = Window.partitionBy("_keep", *collector.key).orderBy(collector.prefer().desc(), "_url", "_at")
    rows = rows.withColumn("_first", F.col("_keep") & (F.row_number().over(best) == 1))
    kept = rows.where("_first")
    if collector.most is not None and collector.per is not None:
        kept = kept.withColumn("_n", F.row_number().over(Window.partitionBy(collector.per).orderBy("_url", "_at"))).where(F.col("_n") <= collector.most)
    elif collector.most is not None:
        kept = kept.orderBy("_url", "_at").limit(collector.most)
    bodies = own.agg(F.count("*").alias("bodies"), F.max(total).alias("declared"))
    counts = rows.agg(F.count("*").alias("parsed"), F.count_if("_keep").alias("kept"), F.count_if("_first").alias("unique"))
    found = bodies.join(counts, F.lit(True))
    if collector.per is not None and collector.most is not None:
        cut = rows.where("_first").groupBy(collector.per).agg(F.greatest(F.lit(0), F.count("*") - collector.most).alias("_over")).agg(F.sum("_over").alias("_over"))
        found, over = found.join(cut, F.lit(True)), F.coalesce("_over", F.lit(0))
    else:
        over = F.lit(0).cast("long") if collector.most is None else F.greatest(F.lit(0), F.col("unique") - collector.most)
    found = found.withColumn("truncated", over).withColumn("complete", (F.col("bodies") > 0) & F.coalesce(F.col("parsed") >= F.col("declared"), F.lit(True)) & (F.col("truncated") == 0))
    return kept.select(*FIELDS), found.select(F.lit(collector.source).alias("source"), "bodies", "declared", "parsed", "kept", "unique", "truncated", "complete")


def collect_all(payloads: DataFrame, collectors: Sequence[Collector]) -> tuple[DataFrame, DataFrame]:
    """The records and the diagnostics of several sources, in their order."""
    made = [collect(payloads, c) for c in collectors]
    records, found = made[0]
    for r, d in made[1:]:
        records, found = records.unionByName(r), found.unionByName(d)
    return records, found


class CapturedPayloads(DataSource):
    """spark.read.format("captured").load(folder): files of JSON lines {"source", "url", "fetched_at", "body"}, a task each.

    Lines that are no such JSON give a row with the file as url and a null body, so that nothing vanishes. The folder must be
    readable by all executors under the same path.
    """

    @classmethod
    def name(cls) -> str:
        return "captured"

    def schema(self) -> str:
        return "source string, url string, fetched_at string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _CapturedReader(self.options["path"])


class _CapturedReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def partitions(self) -> Sequence[InputPartition]:
        names = sorted(n for n in os.listdir(self.path) if n.endswith((".jsonl", ".json")))
        return [InputPartition(os.path.join(self.path, n)) for n in names] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        with open(partition.value, encoding="utf-8") as lines:
            for line in lines:
                try:
                    x = json.loads(line)
                    yield tuple(x.get(c) for c in ("source", "url", "fetched_at", "body"))
                except (ValueError, AttributeError):
                    yield None, partition.value, None, None


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CapturedPayloads)
