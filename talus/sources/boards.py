"""Collectors of several boards and their details as one source."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.dedup import first_values_joined
from .collect import Collector, collect
from .payloads import FIELDS


@dataclass(frozen=True)
class Board:
    """A list of records: its endpoints are asked in order, and the first that gives any record speaks for the board."""

    name: str
    endpoints: Sequence[Collector]
    required: bool = True


@dataclass(frozen=True)
class BoardSet:
    """How the boards of one source make its records.

    key: what makes two records the same, as an expression of their fields; blank_key() takes the address or, without one,
    title, company and place. longest: fields of which the longest value of a record's boards stays; joined: fields whose
    distinct values are joined by "; " in the order of the boards. details: a collector of single records, and detail_key,
    the field that leads from a listing to its detail; what a detail has overrides the listing. watch: records that are only
    reported apart. prefix: records without an id get one from their key.
    """

    source: str
    boards: Sequence[Board]
    key: Callable[[], Column] = field(default=lambda: blank_key())
    longest: Sequence[str] = ("title",)
    joined: Sequence[str] = ("search_query",)
    details: Collector | None = None
    detail_key: str = "url"
    watch: Callable[[], Column] = field(default=lambda: F.lit(False))
    prefix: str | None = None


def blank_key() -> Column:
    """The address; where it is blank title, company and place in lower case."""
    return F.when(F.col("url") != "", F.col("url")).otherwise(F.concat_ws("|", F.lit(""), *(F.lower(F.trim(c)) for c in ("title", "company", "location"))))


def collect_boards(payloads: DataFrame, spec: BoardSet) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, watch-only records, diagnostics) of payloads (source, url, body), whose source is the name of an endpoint.

    records: FIELDS, one for each key, the source's name in source; of a key the first board's record stays, but for longest
    and joined fields. diagnostics: for each board in its order board, required, endpoint (the place of the one that spoke,
    from 1, or 0), declared, parsed, records (that it gave), new (keys that no board before it had), complete (it gave all
    that it declared), and source_complete (all required boards are complete). payloads must be staged: they are read for
    each endpoint.
    """
    rows, said = [], []
    for b, board in enumerate(spec.boards):
        for e, endpoint in enumerate(board.endpoints, 1):
            found, diagnostics = collect(payloads, endpoint)
            rows.append(found.select(F.lit(b).alias("_b"), F.lit(e).alias("_e"), *FIELDS))
            said.append(diagnostics.select(F.lit(b).alias("_b"), F.lit(e).alias("_e"), F.lit(board.name).alias("board"), F.lit(board.required).alias("required"), "declared", "parsed", F.col("unique").alias("records"), "complete"))
    rows, said = (reduce(DataFrame.unionByName, x) for x in (rows, said))
    # a row for each endpoint
    spoke = said.where("records > 0").groupBy("_b").agg(F.min("_e").alias("_e"))
    own = rows.join(F.broadcast(spoke), ["_b", "_e"]).withColumn("_same", spec.key()).withColumn("_o", F.struct("_b", "url", "id", "title"))
    kept = [c for c in FIELDS if c not in (*spec.longest, *spec.joined)]
    longest = [F.max_by(c, F.struct(F.length(c), -F.col("_b"), c)).alias(c) for c in spec.longest]
    merged = own.groupBy("_same").agg(F.min("_b").alias("_b"), F.min_by(F.struct(*kept), "_o").alias("_r"), *longest).select("_same", "_b", "_r.*", *spec.longest)
    for c in spec.joined:
        merged = first_values_joined(merged, own.where(F.col(c) != ""), "_same", "_o", c, "; ")
    if spec.details is not None:
        single = collect(payloads, spec.details)[0]
        single = single.groupBy(F.col(spec.detail_key).alias("_d")).agg(*(F.max(c).alias(f"_d_{c}") for c in FIELDS if c not in ("source", spec.detail_key))).where("_d <> ''")
        over = [F.coalesce(F.nullif(F.col(f"_d_{c}"), F.lit("")), F.col(c)).alias(c) if c not in ("source", spec.detail_key) else F.col(c) for c in FIELDS]
        merged = merged.join(single, F.col(spec.detail_key) == F.col("_d"), "left").select("_same", "_b", *over)
    if spec.prefix is not None:
        merged = merged.withColumn("id", F.when(F.col("id") == "", F.concat(F.lit(spec.prefix), F.substring(F.sha1("_same"), 1, 16))).otherwise(F.col("id")))
    merged = merged.withColumn("source", F.lit(spec.source)).withColumn("_w", F.coalesce(spec.watch(), F.lit(False)))
    firsts = merged.groupBy("_b").agg(F.count("*").alias("new"))
    each = said.join(F.broadcast(spoke.withColumnRenamed("_e", "_s")), "_b", "left").where(F.col("_e") == F.coalesce("_s", F.lit(1))).withColumn("endpoint", F.coalesce("_s", F.lit(0)))
    each = each.join(F.broadcast(firsts), "_b", "left").select("_b", "board", "required", "endpoint", "declared", "parsed", "records", F.coalesce("new", F.lit(0)).alias("new"), (F.col("complete") & (F.col("endpoint") > 0)).alias("complete"))
    whole = each.agg(F.min(F.when(F.col("required"), F.col("complete").cast("int"))).alias("_c")).select((F.coalesce("_c", F.lit(1)) == 1).alias("source_complete"))
    return merged.where("NOT _w").select(*FIELDS), merged.where("_w").select(*FIELDS), each.join(F.broadcast(whole), F.lit(True)).drop("_b")
