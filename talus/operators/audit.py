"""Coverage, overlap, health and completeness of sources and runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_sources(provenance: Column, source: Column) -> Column:
    """Sources of a record: those of its provenance, else those joined by + in its source."""
    own = F.array_distinct(provenance)
    return F.when(F.size(own) > 0, own).otherwise(F.filter(F.split(F.coalesce(source, F.lit("")), "\\+"), lambda x: x != ""))


def contribution(rows: DataFrame, sources: str, act: Column, configured: DataFrame | None = None) -> DataFrame:
    """A row a source: records, those of no other source, shared ones, actionable ones and share of exclusive records.

    configured (source): each source that it names has a row, with zeros where no record has it.
    """
    each = rows.select(F.explode(sources).alias("source"), F.size(sources).alias("n"), act.alias("act"))
    out = each.groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("n") == 1).alias("exclusive"), F.count_if(F.col("n") > 1).alias("shared"), F.count_if("act").alias("actionable"), F.count_if(F.col("act") & (F.col("n") == 1)).alias("exclusive_actionable"))
    if configured is not None:
        out = configured.select("source").distinct().join(out, "source", "full").na.fill(0)
    return out.withColumn("exclusive_share", F.round(ratio(F.col("exclusive"), F.col("total"), 0.0), 4))


def partners(rows: DataFrame, sources: str) -> DataFrame:
    """(source, partners): for each source, how many records it shares with each other one, as a map by name."""
    o = overlap(rows, sources, F.lit(False))
    both = o.select(F.col("a").alias("source"), F.col("b").alias("other"), "n").unionByName(o.select(F.col("b").alias("source"), F.col("a").alias("other"), "n"))
    return both.groupBy("source").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("other", "n")))).alias("partners"))


def measured(rows: DataFrame, by: str, measures: Mapping[str, Column]) -> DataFrame:
    """Any number of conditional counts of each group, in one pass."""
    return rows.groupBy(by).agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in measures.items()))


def overlap(rows: DataFrame, sources: str, act: Column) -> DataFrame:
    """(a, b, n, actionable) of each pair of sources with records in common. Pairs come out of each record's own list."""
    s = F.array_sort(F.array_distinct(sources))
    pairs = F.flatten(F.transform(s, lambda x, i: F.transform(F.slice(s, i + 2, F.size(s)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return rows.select(F.explode(pairs).alias("p"), act.alias("act")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"), F.count_if("act").alias("actionable"))


def largest_overlaps(overlaps: DataFrame, most: int) -> DataFrame:
    """The pairs of overlap() that share most records, most of them at the utmost; ties by names."""
    return overlaps.orderBy(F.desc("n"), "a", "b").limit(most)


def totals(rows: DataFrame, sources: str) -> DataFrame:
    """One row: records with one source, several and none."""
    n = F.size(sources)
    return rows.agg(F.count("*").alias("total"), F.count_if(n == 1).alias("single"), F.count_if(n > 1).alias("multi"), F.count_if(n == 0).alias("unattributed"))


def source_status(error: Column, coverage: Column, detail: Column) -> Column:
    """ERROR, OK (coverage and detail complete) or PARTIAL."""
    return F.when(F.coalesce(error, F.lit("")) != "", "ERROR").when(coverage & detail, "OK").otherwise("PARTIAL")


def hard_error(fetched: Column, n_errors: Column, warning: Column, otherwise: str) -> Column:
    """The error text of a scan that fetched nothing and met errors: such a run failed, it is not merely incomplete."""
    failed = (F.coalesce(fetched, F.lit(0)) == 0) & (F.coalesce(n_errors, F.lit(0)) > 0)
    return F.when(failed, F.coalesce(F.nullif(warning, F.lit("")), F.lit(otherwise))).otherwise("")


def coverage_complete(complete: Column, n_errors: Column, truncated: Column) -> Column:
    return F.coalesce(complete, F.lit(False)) & (F.coalesce(n_errors, F.lit(0)) == 0) & (F.coalesce(truncated, F.lit(0)) == 0)


def warnings(conditions: Mapping[str, Column]) -> Column:
    """The texts whose conditions hold, in order, each once."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(c, F.lit(t)) for t, c in conditions.items()))))


def ratio(part: Column, whole: Column, empty: float) -> Column:
    """part over whole; empty where there is nothing."""
    return F.when(whole == 0, F.lit(empty)).otherwise(part / whole)


def zero_filled(rows: DataFrame, by: Sequence[str], value: str, domain: Sequence[str]) -> DataFrame:
    """Counts of each value of a closed domain for each group, zeros included; others do not count."""
    counts = [F.count_if(F.col(value) == v).alias(v) for v in domain]
    wide = rows.groupBy(*by).agg(*counts)
    return wide.select(*by, F.explode(F.create_map(*(x for v in domain for x in (F.lit(v), F.col(v))))).alias(value, "n"))


def health(rows: DataFrame, by: Sequence[str], status: str) -> DataFrame:
    """OK, PARTIAL and ERROR counts of each group; an unknown status is an error."""
    s = F.coalesce(F.col(status), F.lit(""))
    return rows.groupBy(*by).agg(F.count_if(s == "OK").alias("ok"), F.count_if(s == "PARTIAL").alias("partial"), F.count_if(~s.isin("OK", "PARTIAL")).alias("error"))


def best_attempt(rows: DataFrame, key: Sequence[str], measures: Sequence[str], attempt: str) -> DataFrame:
    """The attempt of the greatest measures in lexicographic order; the earliest of equals."""
    w = Window.partitionBy(*key).orderBy(*(F.desc(m) for m in measures), F.col(attempt))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def page_signatures(rows: DataFrame, scan: str, page: str, item: str) -> DataFrame:
    """(scan, page, signature, repeated): a page whose set of items came before in its scan is repeated."""
    pages = rows.groupBy(scan, page).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.col(item).cast("string"))), ","), 256).alias("signature"))
    w = Window.partitionBy(scan, "signature").orderBy(page)
    return pages.withColumn("repeated", F.row_number().over(w) > 1)


def cutoff(rows: DataFrame, page: str, day: str, oldest: Column, scan: Sequence[str] = ()) -> DataFrame:
    """Rows not older than the cutoff, undated ones included, of the pages before their scan stops.

    A scan stops after the first page whose newest date is older than the cutoff; pages of one number belong together only
    within a scan. Without scan all rows are one.
    """
    old = rows.groupBy(*scan, page).agg((F.max(day) < oldest).alias("old")).where("old")
    kept = rows.where(F.col(day).isNull() | (F.col(day) >= oldest))
    if not scan:
        return kept.where(F.col(page) <= F.coalesce(old.agg(F.min(page)).scalar(), F.col(page)))
    stop = old.groupBy(*(F.col(c).alias(f"_s{i}") for i, c in enumerate(scan))).agg(F.min(page).alias("_stop"))
    met = F.lit(True)
    for i, c in enumerate(scan):
        met &= F.col(c).eqNullSafe(F.col(f"_s{i}"))
    return kept.join(stop, met, "left").where(F.col("_stop").isNull() | (F.col(page) <= F.col("_stop"))).select(*rows.columns)


def dated(rows: DataFrame, by: Sequence[str], day: str) -> DataFrame:
    """(by, first_day, last_day, dated, undated): how many rows have a date, and the range of those that have one."""
    there = F.col(day).isNotNull()
    return rows.groupBy(*by).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count_if(there).alias("dated"), F.count_if(~there).alias("undated"))


def deferred(rows: DataFrame, key: Sequence[str], order: str, limited: Column) -> DataFrame:
    """Adds deferred: an earlier row of the key was rate-limited."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("deferred", F.coalesce(F.max(limited.cast("int")).over(w), F.lit(0)) == 1)


def day_spine(days: DataFrame, day: str, first: str, last: str, most: int = 31) -> DataFrame:
    """Each day of the range, most of them at the utmost, with its rows n; missing if there are none."""
    import datetime

    if (datetime.date.fromisoformat(last) - datetime.date.fromisoformat(first)).days >= most:
        raise ValueError(f"more than {most} days")
    spine = days.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("day"))
    counts = days.groupBy(F.col(day).alias("day")).agg(F.count("*").alias("n"))
    return spine.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("missing"))


def newest_complete(rows: DataFrame, key: Sequence[str], complete: Column, order: Sequence[Column]) -> DataFrame:
    """The newest complete run of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.where(complete).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def manifest(rows: DataFrame, key: str, content: str) -> DataFrame:
    """key and SHA-256 of each content."""
    return rows.select(key, F.sha2(F.coalesce(F.col(content), F.lit("")), 256).alias("sha256"))


def verify(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key and verdict: ok, changed, missing or extra."""
    j = expected.select(key, F.col("sha256").alias("_e")).join(found.select(key, F.col("sha256").alias("_f")), key, "full")
    return j.select(key, F.when(F.col("_f").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(F.col("_e") == F.col("_f"), "ok").otherwise("changed").alias("verdict"))
