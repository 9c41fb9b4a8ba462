"""Routing into views, ranked orders and truncation with accounts."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import rank
from ..functions.text import normalize

PRIMARY = ("STRONG_APPLY", "APPLY", "REVIEW")


def standard_views(recommendation: Column, status: Column, seen: Column, has_event: Column, resolved: Column) -> dict[str, Column]:
    """The views' predicates. has_event: any event of detail quality; resolved: the detail was found at last, which alone
    brings a known record up again."""
    r, a, s = (F.coalesce(c, F.lit("")) for c in (recommendation, status, seen))
    event, resolved = F.coalesce(has_event, F.lit(False)), F.coalesce(resolved, F.lit(False))
    primary, low, unresolved, open_ = r.isin(*PRIMARY), r == "LOW_PRIORITY", r == "NEEDS_DETAIL_REVIEW", a != "CLOSED"
    actionable = (primary | low | unresolved) & open_
    return {
        "all_evaluated": ~unresolved, "needs_detail_review": unresolved, "primary": primary, "low": low, "skipped": r == "SKIP", "closed": a == "CLOSED", "actionable_primary": primary & open_, "actionable_low": low & open_, "actionable": actionable,
        "daily_actionable": actionable & (s.isin("NEW", "MATERIALLY_CHANGED", "REOPENED") | resolved), "new_actionable": actionable & (s == "NEW"), "changed_or_reopened": s.isin("MATERIALLY_CHANGED", "REOPENED"), "seen_unchanged": (s == "SEEN") & ~event, "state_quality_events": event, "all_canonical": F.lit(True),
    }


def route(rows: DataFrame, views: Mapping[str, Column], keep: Sequence[str]) -> DataFrame:
    """(view, keep...): a row for each view that a record is in. One pass, whatever the number of views."""
    names = F.array_compact(F.array(*(F.when(p, F.lit(v)) for v, p in views.items())))
    return rows.select(F.explode(names).alias("view"), *keep)


def ranked(rows: DataFrame, recommendation: str, score: str, title: str) -> DataFrame:
    """By recommendation, score from the top (none counts as -1), title."""
    return rows.orderBy(rank(F.col(recommendation)), F.desc(F.coalesce(score, F.lit(-1))), F.col(title))


def top_n(rows: DataFrame, order: Sequence[Column], n: int, group: Sequence[str]) -> DataFrame:
    """The first n rows of each group, with place and with truncated, the number of rows left out.

    Places alone decide, so that each task keeps n rows of a group before the shuffle; the groups are counted apart, which
    adds up before its own shuffle.
    """
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= n)
    counts = rows.groupBy(*(F.col(g).alias(f"_{g}") for g in group)).agg(F.greatest(F.lit(0), F.count("*") - n).alias("truncated"))
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    if not group:  # one row of counts
        return first.withColumn("truncated", counts.scalar())
    return first.join(counts, same).drop(*(f"_{g}" for g in group))


def triage(text: Column, reject: str, role: str, domain: str, distant: str, protected: str) -> Column:
    """struct<keep, reasons> of a listing card."""
    t = F.coalesce(text, F.lit(""))
    is_role, is_domain, is_distant, is_protected, rejected = (t.rlike(p) for p in (role, domain, distant, protected, reject))
    reasons = F.array_compact(F.array(F.when(rejected, "rejected"), F.when(is_role, "role"), F.when(is_domain, "domain"), F.when(is_distant, "distant"), F.when(is_protected, "protected")))
    return F.struct((~rejected & (is_protected | is_domain | (is_role & ~is_distant))).alias("keep"), reasons.alias("reasons"))


def actionable(recommendation: Column, status: Column) -> Column:
    return (F.coalesce(recommendation, F.lit("")) != "SKIP") & (F.coalesce(status, F.lit("")) != "CLOSED")


def in_country(names: Sequence[str], *texts: Column) -> Column:
    """Whether one of the texts names the country, as a word of its own, accents and case aside; names are words in lower case."""
    if not names:
        return F.lit(False)
    whole = F.concat(F.lit(" "), normalize(F.concat_ws(" ", *texts)), F.lit(" "))
    return whole.rlike(f" (?:{'|'.join(map(re.escape, names))}) ")
