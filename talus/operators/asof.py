"""As-of lookups: for each row the entry that held at its own time, with an age limit of its own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import along, carried, ranged


def asof_join(rows: DataFrame, entries: DataFrame, key: Sequence[str], at: str, since: str, values: Sequence[str], ties: Sequence[str] = (), same: Sequence[str] = (), origin: Column | None = None, oldest: float | None = None, before: bool = False) -> DataFrame:
    """rows with the values of the last entry of their key up to their time, and its age in seconds; else nulls.

    at and since: the times of rows and entries. Of entries of one time that with the greatest ties holds. same: further
    columns that entry and row must agree in, in which null agrees with nothing either. origin: when an entry's content is
    from, if that is before the entry was made (a copy of an older entry): then the entry of the latest origin holds, and ages
    count from there. oldest: the age in seconds beyond which an entry does not count; the one that holds decides, an older one
    does not take its place. before: only entries before a row's time count, not those of the same moment.

    Both sides are put in one order and the best entry so far is a running maximum, within ranges of that order and across
    them, so a key with most of the rows is spread over as many tasks as its rows take. A null key or time meets nothing; rows
    keep their number and their order has no meaning. Value columns of rows that have the name of a value are replaced.
    """
    keys = [*key, *same]
    kept = [c for c in rows.columns if c not in {*values, "age_seconds"}]
    rank = F.struct((F.col(since) if origin is None else origin).alias("origin"), *(F.col(c).alias(f"t{i}") for i, c in enumerate(ties)), F.struct(*values).alias("value"))
    named = lambda df: [F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)]
    whole = rows.select(*named(rows), F.col(at).cast("timestamp").alias("_t"), F.lit(int(not before)).alias("_side"), F.struct(*kept).alias("_row"))
    known = entries.select(*named(entries), F.col(since).cast("timestamp").alias("_t"), F.lit(int(before)).alias("_side"), rank.alias("_entry"))
    known = known.dropna(subset=[c for c in known.columns if c.startswith("_k") or c == "_t"])
    order, on = ["_t", "_side"], [f"_k{i}" for i in range(len(keys))]
    parts = ranged(whole.unionByName(known, allowMissingColumns=True), on, order)
    so_far = Window.partitionBy("_part", *on).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = along(parts.withColumn("_own", F.max("_entry").over(so_far)), on, carried(parts, on, {"_best": F.max("_entry")}, {"_before": F.max("_best")}))
    found = held.where(F.col("_row").isNotNull()).select("_row", "_t", F.greatest("_own", "_before").alias("_e"))
    age = (F.unix_micros("_t") - F.unix_micros(F.col("_e.origin").cast("timestamp"))) / 1e6
    found = found.withColumn("_age", age)
    if oldest is not None:
        found = found.withColumn("_age", F.when(F.col("_age") <= oldest, F.col("_age")))
    counts = F.col("_age").isNotNull()
    return found.select("_row.*", *(F.when(counts, F.col(f"_e.value.{c}")).alias(c) for c in values), F.col("_age").alias("age_seconds"))
