"""Reports as frames: sheets of a workbook, partitions of unresolved records, summaries as JSON."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .views import ranked


def sheets(rows: DataFrame, predicates: Mapping[str, Column], columns: Sequence[str], recommendation: str = "recommendation", score: str = "score", title: str = "title") -> dict[str, DataFrame]:
    """A frame for each sheet, with the columns that are there in the order given, in rank order. Layout is the caller's."""
    there = [c for c in columns if c in rows.columns]
    return {name: ranked(rows.where(F.coalesce(p, F.lit(False))), recommendation, score, title).select(*there) for name, p in predicates.items()}


def unresolved(rows: DataFrame, source: str, name: str, resolved: Column) -> tuple[DataFrame, DataFrame]:
    """Records without a resolved detail: (of the source named, of all others). A record of several sources joined by + is of
    the named one if that is among them."""
    open_ = rows.where(~F.coalesce(resolved, F.lit(False)))
    mine = F.array_contains(F.split(F.coalesce(F.col(source), F.lit("")), "\\+"), name)
    return open_.where(mine), open_.where(~mine)


def summary(rows: DataFrame, measures: Mapping[str, Column]) -> DataFrame:
    """One row, one column json: the counts of rows that meet each measure, and total, as a JSON object with sorted keys."""
    counts = {"total": F.count("*")} | {n: F.count_if(F.coalesce(c, F.lit(False))) for n, c in measures.items()}
    return rows.agg(F.to_json(F.struct(*(counts[n].alias(n) for n in sorted(counts)))).alias("json"))
