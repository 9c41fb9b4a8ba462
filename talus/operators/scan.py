"""Control of paginated scans, as data: where and why a scan stops, what it covered, which sources run, second passes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Why a scan stops, in the order in which a page is asked.
REASONS = ("error", "empty_page", "repeat", "cutoff_reached", "last_page", "configured_page_limit", "time_budget")


def stops(pages: DataFrame, scan: str, page: str, error: Column, items: Column, signature: Column, newest: Column, last: Column, oldest: Column | None = None, page_limit: int | None = None, elapsed: Column | None = None, budget: int | None = None) -> DataFrame:
    """(scan, stop_page, stop_reason, repeated): the first page of each scan with a reason to stop, and that reason.

    A page is asked in the order of REASONS. It repeats if its signature came before in its scan; the cutoff is reached if
    its newest date is older than oldest (undated pages are not old). A scan whose pages give no reason ran out of them:
    stop_reason is then null, stop_page its last page. A page may be there once only.
    """
    no = F.lit(False)
    seen = F.row_number().over(Window.partitionBy(scan, F.col("_signature")).orderBy(page)) > 1
    x = pages.withColumn("_signature", signature).withColumn("_repeat", seen)
    conditions = (
        F.coalesce(error, F.lit("")) != "", items == 0, F.col("_repeat"), no if oldest is None else newest < oldest, last,
        no if page_limit is None else F.col(page) >= page_limit, no if budget is None else elapsed >= budget,
    )
    reason = F.coalesce(*(F.when(F.coalesce(c, no), F.lit(r)) for r, c in zip(REASONS, conditions, strict=True)))
    x = x.withColumn("_reason", reason)
    first = F.min(F.when(F.col("_reason").isNotNull(), F.struct(F.col(page).alias("p"), F.col("_reason").alias("r"))))
    return x.groupBy(scan).agg(first.alias("_f"), F.max(page).alias("_last"), F.max(F.col("_repeat").cast("int")).alias("_any")).select(scan, F.coalesce("_f.p", "_last").alias("stop_page"), F.col("_f.r").alias("stop_reason"), (F.col("_any") == 1).alias("repeated"))


def read(pages: DataFrame, stopped: DataFrame, scan: str, page: str) -> DataFrame:
    """The pages that a scan took in: those before its stop, and the stop itself unless it gave nothing new."""
    empty = F.coalesce(F.col("stop_reason").isin("error", "empty_page", "repeat"), F.lit(False))
    return pages.join(stopped.select(scan, "stop_page", "stop_reason"), scan).where((F.col(page) < F.col("stop_page")) | ((F.col(page) == F.col("stop_page")) & ~empty)).drop("stop_page", "stop_reason")


def covered(reason: Column, n_errors: Column, repeated: Column, honoured: Column, oldest_seen: Column | None = None, cutoff: Column | None = None) -> Column:
    """A live scan is complete if it met the last page; a historical one if it reached its cutoff. Neither is after errors,
    repeated pages, or a filter that the site did not honour."""
    clean = (F.coalesce(n_errors, F.lit(0)) == 0) & ~F.coalesce(repeated, F.lit(False)) & F.coalesce(honoured, F.lit(True))
    reason = F.coalesce(reason, F.lit(""))
    ended = reason.isin("last_page", "empty_page") if cutoff is None else (reason == "cutoff_reached") | F.coalesce(oldest_seen <= cutoff, F.lit(False))
    return clean & ended


def detail_complete(n_failed: Column) -> Column:
    """No detail failed; an unknown number counts as none."""
    return F.coalesce(n_failed, F.lit(0)) == 0


def honoured(matching: Column, total: Column, least: float) -> Column:
    """Whether a site honoured a filter: the share of rows that match it. Without rows there is nothing to say against it."""
    return F.when(F.coalesce(total, F.lit(0)) == 0, F.lit(True)).otherwise(matching / total >= least)


def select_sources(registered: Sequence[str], wanted: str, groups: Mapping[str, Sequence[str]] | None = None) -> list[str]:
    """The sources to run, in the order in which they are registered; all, a group's name, or one source."""
    named = {"all": list(registered), **(groups or {})}
    chosen = named.get(wanted, [wanted] if wanted in registered else None)
    if chosen is None:
        raise ValueError(f"unknown source {wanted!r}")
    return [s for s in registered if s in chosen]


def facets(html: Column, name: str) -> Column:
    """map of label to value of the options of a select element; empty values go."""
    body = F.regexp_extract(F.coalesce(html, F.lit("")), rf"(?is)<select\b[^>]*\bname=[\"']{name}[\"'][^>]*>(.*?)</select>", 1)
    options = F.regexp_extract_all(body, F.lit(r"(?is)(<option\b[^>]*>[^<]*)"), F.lit(1))
    pairs = F.transform(options, lambda o: F.struct(F.trim(F.regexp_extract(o, r"(?s)>([^<]*)$", 1)).alias("k"), F.regexp_extract(o, r"(?is)\bvalue=[\"']([^\"']*)", 1).alias("v")))
    kept = F.filter(pairs, lambda p: (p["v"] != "") & (p["k"] != ""))
    # The first option of a label counts.
    labels = F.transform(kept, lambda p: p["k"])
    return F.map_from_entries(F.filter(kept, lambda p, i: F.array_position(labels, p["k"]) == i + 1))


def resolved_twice(rows: DataFrame, key: str, resolve: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, tasks: int, transient: str) -> DataFrame:
    """Each row resolved in one of so many tasks; rows whose status is transient (a pattern) once more, after all others.

    resolve maps frames of rows to frames of schema, which has key and status; a row's result stands under its key, so order
    is the caller's to restore.
    """
    first = cut(rows.repartition(tasks, key).mapInPandas(resolve, schema))
    failed = F.coalesce(F.col("status"), F.lit("")).rlike(transient)
    again = rows.join(first.where(failed).select(key), key, "left_semi").repartition(tasks, key).mapInPandas(resolve, schema)
    return first.where(~failed).unionByName(again)
