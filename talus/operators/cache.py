"""Lookups in caches whose entries age."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def freshest(cache: DataFrame, key: Sequence[str], age: Column, order: str, oldest: int) -> DataFrame:
    """The youngest entry of each key within the age limit; the earliest of equals."""
    w = Window.partitionBy(*key).orderBy("age_days", order)
    return cache.withColumn("age_days", age).where(F.col("age_days").between(0, oldest)).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def carried_age(snapshot_age: Column, prior: Column) -> Column:
    """Age of an entry that was itself copied from a cache: the ages add up; an unreadable prior age counts as none."""
    return snapshot_age + F.coalesce(F.expr("null") if prior is None else prior.try_cast("int"), F.lit(0))


def split(rows: DataFrame, cache: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(hits, misses)."""
    keys = cache.select(*key).distinct()
    return rows.join(keys, list(key), "left_semi"), rows.join(keys, list(key), "left_anti")


def guarded_lookup(rows: DataFrame, cache: DataFrame, key: str, same: Sequence[str], value: str, age: Column | None = None, oldest: int | None = None) -> DataFrame:
    """rows with the cache's value where the key hits and the fields in same agree; else null.

    Of entries with equal keys and fields the youngest by age counts, then the least value, so no row is repeated; entries
    older than oldest do not count.
    """
    cache = cache.withColumn("_age", F.lit(0) if age is None else age).where("_age >= 0" if oldest is None else f"_age BETWEEN 0 AND {oldest}")
    cache = cache.groupBy(key, *same).agg(F.min_by(value, F.struct("_age", value)).alias(value))
    c = cache.select(F.col(key).alias("_k"), *(F.col(s).alias(f"_{s}") for s in same), F.col(value).alias("cached"))
    on = F.col(key) == F.col("_k")
    for s in same:
        on = on & (F.col(s) == F.col(f"_{s}"))
    return rows.join(c, on, "left").drop("_k", *(f"_{s}" for s in same))


def prefill(rows: DataFrame, key: str, caches: Sequence[DataFrame], value: str) -> DataFrame:
    """rows with the value of the first cache that has the key, and from_cache, its place from 1 (0: none has it).

    Caches are asked in the order given: what is fresh first, what is to fall back on last. Keys are unique in each cache.
    """
    out, found, place = rows, F.lit(None), F.lit(0)
    for i, c in reversed(list(enumerate(caches, 1))):
        out = out.join(c.select(F.col(key).alias(f"_k{i}"), F.col(value).alias(f"_v{i}")), F.col(key) == F.col(f"_k{i}"), "left")
        found, place = F.when(F.col(f"_k{i}").isNotNull(), F.col(f"_v{i}")).otherwise(found), F.when(F.col(f"_k{i}").isNotNull(), i).otherwise(place)
    return out.select(*rows.columns, found.alias(value), place.alias("from_cache"))
