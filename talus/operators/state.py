"""Seen history: today's records against the persistent state, as joins.

A state row has state_id, aliases, first_seen, last_seen, times_seen and last_snapshot. Records come with their ordinal
and ranked aliases.
"""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TITLES_ALIKE, normalize, title_core, titles_differ, tokens
from .lineage import dropped, staged

OPEN = ("OPEN", "OPEN_UNTIL_FILLED")
SIMHASH_DISTANCE = 14


def aliases(source: Column, id_: Column, url: Column, listing: Column, title: Column, company: Column, location: Column) -> Column:
    """Ranked aliases: 0 source and id, 1 own URL, 2 listing URL and title, 3 company, title and place; blank ones go."""
    make = lambda rank, ok, *parts: F.when(ok, F.struct(F.lit(rank).alias("rank"), F.concat_ws("|", *parts).alias("alias")))
    found = F.array(make(0, id_ != "", F.lit("id"), source, id_), make(1, (url != "") & ~listing, F.lit("url"), url), make(2, (url != "") & listing & (title != ""), F.lit("listing"), url, title), make(3, (company != "") & (title != ""), F.lit("text"), company, title, location))
    return F.array_distinct(F.array_compact(found))


def snapshot(fields: dict[str, Column], detail: Column, detail_ok: Column, simhash: Column, score: Column | None = None) -> Column:
    """What a state row keeps of a record: normalised names, deadline and status (UNKNOWN if blank, in capitals), and of a
    detail that can be relied on its simhash and number of words."""
    text_ = lambda n: normalize(fields[n]) if n in fields else F.lit("")
    plain = lambda n: F.trim(F.coalesce(fields[n].cast("string"), F.lit(""))) if n in fields else F.lit("")
    ok = F.coalesce(detail_ok, F.lit(False))
    return F.struct(
        *(text_(n).alias(n) for n in ("title", "company", "location", "modality")), plain("application_deadline").alias("application_deadline"),
        F.upper(F.coalesce(F.nullif(plain("application_status"), F.lit("")), F.lit("UNKNOWN"))).alias("application_status"), plain("recommendation").alias("recommendation"),
        F.lit(None).cast("int").alias("score") if score is None else score.try_cast("int").alias("score"), F.when(ok, simhash).alias("simhash"), F.when(ok, F.size(tokens(normalize(detail)))).otherwise(0).alias("detail_words"), ok.alias("resolved"),
    )


def state_id(alias: Column) -> Column:
    return F.concat(F.lit("job_"), F.substring(F.sha1(alias), 1, 20))


def checked(state: DataFrame, version: int, known: Sequence[int]) -> DataFrame:
    """state, if its version is known and it has a state's columns; anything else is an error, never an empty history."""
    lacking = [c for c in ("state_id", "aliases", "first_seen", "last_seen", "times_seen", "last_snapshot") if c not in state.columns]
    if version not in known or lacking:
        raise ValueError(f"state version {version} lacks {lacking}" if lacking else f"unknown state version {version}")
    return state


def alias_index(state: DataFrame) -> DataFrame:
    """(alias, state_id) of the aliases that name one state row only."""
    each = state.select("state_id", F.explode("aliases").alias("alias"))
    return each.groupBy("alias").agg(F.min("state_id").alias("state_id"), F.max("state_id").alias("_last"), F.count_if(F.col("state_id").isNull()).alias("_none")).where("state_id = _last AND _none = 0").drop("_last", "_none")


def _ranked(least: int, most: int) -> Column:
    return F.transform(F.filter("aliases", lambda x: x["rank"].between(least, most)), lambda x: x["alias"])


def match(rows: DataFrame, index: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """rows (ord, aliases) with the state_id they match or null: the hit of least rank; strong aliases (0, 1) shut out weak.

    With state (then rows have a snapshot with a title) an id that a source has given to another record is no hit: one
    whose state row has other URLs and a clearly different title. reused tells of such a row.
    """
    strong = F.exists("aliases", lambda x: x["rank"] <= 1)
    # Only what may be compared travels with an alias: the URLs and title of a record that has URLs, beside its id.
    own = F.when(F.size(_ranked(1, 1)) > 0, F.struct(_ranked(1, 1).alias("urls"), F.coalesce("snapshot.title", F.lit("")).alias("title"))) if state is not None else F.lit(None)
    each = rows.select("ord", own.alias("own"), F.explode(F.filter("aliases", lambda x: (x["rank"] <= 1) | ~strong)).alias("x"))
    each = each.select("ord", "x.rank", "x.alias", F.when(F.col("x.rank") == 0, F.col("own")).alias("own"))
    hits = each.join(index, "alias")
    if state is not None:
        hits = staged(hits)
        was = state.select("state_id", F.filter("aliases", lambda x: x.startswith("url|")).alias("old_urls"), F.coalesce("last_snapshot.title", F.lit("")).alias("old_title"))
        claimed = hits.where("own IS NOT NULL").join(was.where("size(old_urls) > 0"), "state_id").where("NOT arrays_overlap(own.urls, old_urls)")
        other = staged(claimed.where(titles_differ(F.col("old_title"), F.col("own.title"))).select("ord", "alias").distinct())
        hits = hits.join(other, ["ord", "alias"], "left_anti")
        rows = rows.join(other.select("ord", F.lit(True).alias("reused")).distinct(), "ord", "left").withColumn("reused", F.coalesce("reused", F.lit(False)))
    best = hits.groupBy("ord").agg(F.min_by("state_id", F.struct("rank", "alias")).alias("state_id"))
    return rows.join(best, "ord", "left")


def split_claims(claims: list[dict]) -> list[dict]:
    """Which of the records that match one state row are other records, in order of ord.

    A claim has ids, urls (its strong aliases), held (those that the state row has) and core (of its title). The first one
    is the state row's own. A later one is split off if it shares no identity with those before it, or if it has the id of
    one of them with other URLs and a clearly different title; then the id stays with both, so that it is ambiguous from
    the next run on. Later claims follow the aliases that went with a part. Each split has its parent, the aliases that
    leave the parent (gone), and the alias that names it (seed).
    """
    parts: list[dict] = [{"claimed": None, "seen": []}]
    moved: dict[str, int | None] = {}
    out = []
    for c in sorted(claims, key=lambda c: c["ord"]):
        strong = [*c["ids"], *c["urls"]]
        own = set(c["ids"] or strong)
        at = next((moved.get(x, 0) for x in strong if (moved[x] is not None if x in moved else x in c["held"])), 0)
        reuse = any(set(ids) & set(c["ids"]) and urls and c["urls"] and not set(urls) & set(c["urls"]) and _differ(core, c["core"]) for ids, urls, core in parts[at]["seen"])
        apart = parts[at]["claimed"] is not None and not own & parts[at]["claimed"]
        found = {"part": at, "parent": None, "seed": parts[at].get("seed"), "gone": None}
        if reuse or apart:
            found = {"part": len(parts), "parent": at, "seed": min(c["urls"]) if reuse else strong[0], "gone": [x for x in strong if not (reuse and x in c["ids"])]}
            parts.append({"claimed": set(), "seen": [], "seed": found["seed"]})
            for x in strong:
                moved[x] = None if reuse and x in c["ids"] and moved.get(x, at) == at else found["part"]
        part = parts[found["part"]]
        part["claimed"] = (part["claimed"] or set()) | own
        part["seen"].append((c["ids"], c["urls"], c["core"]))
        out.append(c | found)
    return out


def _differ(a: str, b: str) -> bool:
    return bool(a and b and a != b and set(a.split()) != set(b.split()) and SequenceMatcher(None, a, b).ratio() < TITLES_ALIKE)


_CLAIM = ("state_id", "strong", "core")


def splits(matched: DataFrame) -> DataFrame:
    """state_id, strong, core, part, parent, seed and gone of the claims of each state row that several differing ones make.

    matched: state_id, ord, strong, ids, urls, held, core. Equal claims share one row, and only state rows with differing
    claims are looked at, so that a fold holds the distinct identities of one state row and no record's text.
    """
    claims = matched.where("state_id IS NOT NULL AND size(strong) > 0").groupBy(*_CLAIM).agg(F.min("ord").alias("ord"), *(F.first(c).alias(c) for c in ("ids", "urls", "held")))
    several = claims.groupBy("state_id").agg(F.count("*").alias("n")).where("n > 1").select("state_id")

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.to_dict("records")
        for r in rows:
            r |= {c: list(r[c]) for c in ("ids", "urls", "held", "strong")}
        return pd.DataFrame([r for r in split_claims(rows) if r["part"]], columns=[*_CLAIM, "part", "parent", "seed", "gone"]).astype({"part": "int32", "parent": "Int32"})

    return claims.join(several, "state_id", "left_semi").groupBy("state_id").applyInPandas(fold, "state_id string, strong array<string>, core string, part int, parent int, seed string, gone array<string>")


def change_reasons(old: str, new: str, fields: Sequence[str], identity: Sequence[str] = ("title", "company"), degraded: Column | None = None, both_resolved: Column | None = None) -> Column:
    """Names of the fields that differ. Where the new detail is degraded only identity fields count; recommendation and a
    simhash further than SIMHASH_DISTANCE count only if both details are resolved."""
    degraded = F.lit(False) if degraded is None else degraded
    out = [F.when(~F.col(f"{old}.{f}").eqNullSafe(F.col(f"{new}.{f}")) & (F.lit(f in identity) | ~degraded), F.lit(f)) for f in fields]
    if both_resolved is not None:
        out.append(F.when(both_resolved & ~F.col(f"{old}.recommendation").eqNullSafe(F.col(f"{new}.recommendation")), F.lit("recommendation")))
        far = F.bit_count(F.col(f"{old}.simhash").bitwiseXOR(F.col(f"{new}.simhash"))) >= SIMHASH_DISTANCE
        out.append(F.when(both_resolved & F.coalesce(far, F.lit(False)), F.lit("detail")))
    return F.array_compact(F.array(*out))


def quality_event(was: Column, is_: Column) -> Column:
    """DETAIL_RESOLVED, DETAIL_UNRESOLVED or null."""
    return F.when(~was & is_, "DETAIL_RESOLVED").when(was & ~is_, "DETAIL_UNRESOLVED")


def sticky(old: Column, new: Column, degraded: Column) -> Column:
    """The old value where the new detail is degraded."""
    return F.when(degraded & old.isNotNull(), old).otherwise(new)


def stored(snapshot: Column, trusted: Column, names: Sequence[str], identity: Sequence[str] = ("title", "company")) -> Column:
    """What is kept of a snapshot: where its detail is not resolved, the fields of the last one that was (null if none was),
    but for names of its own where these are not blank."""
    degraded = trusted.isNotNull() & ~F.coalesce(snapshot["resolved"], F.lit(False))
    own = lambda f: F.coalesce(F.nullif(snapshot[f], F.lit("")), trusted[f]) if f in identity else trusted[f]
    return F.struct(*(F.when(degraded, own(f)).otherwise(snapshot[f]).alias(f) for f in names))


def transition(known: Column, was_status: Column, status: Column, reasons: Column, degraded: Column | None = None) -> Column:
    """NEW, REOPENED (was closed, is open, not degraded), MATERIALLY_CHANGED or SEEN."""
    degraded = F.lit(False) if degraded is None else degraded
    reopened = (was_status == "CLOSED") & status.isin(*OPEN) & ~degraded
    return F.when(~known, "NEW").when(F.coalesce(reopened, F.lit(False)), "REOPENED").when(F.size(reasons) > 0, "MATERIALLY_CHANGED").otherwise("SEEN")


def fold_days(observations: DataFrame, key: str, day: str) -> DataFrame:
    """first_seen, last_seen and times_seen of each key, a day counted once."""
    return observations.select(key, day).distinct().groupBy(key).agg(F.min(day).alias("first_seen"), F.max(day).alias("last_seen"), F.count("*").alias("times_seen"))


def advance(state: DataFrame, rows: DataFrame, day: Column, fields: Sequence[str] = ("title", "company", "location", "application_deadline", "application_status")) -> tuple[DataFrame, DataFrame]:
    """(rows with seen_status, change_reasons, state_events and state_id; the next state).

    rows: ord, aliases, and snapshot (a struct with the fields). A snapshot with a field resolved (whether its detail was
    found) is compared with what is stored: a record whose detail was known and is not found today is degraded, keeps the
    stored detail, changes only by its title or company and is never reopened; state_events tells of details found and
    lost. Without that field every snapshot stands as it is. State rows that no record matches stay as they are. A new
    record's id comes from its first alias (from its URL, if its id was another record's), numbered past the ids that are
    there. Of several records that match one state row each counts and is compared with the one before it, and the last
    one's snapshot stays; those that split_claims() tells apart get a state row of their own, which takes over first_seen.
    """
    titled = "title" in rows.schema["snapshot"].dataType.names
    none = F.array().cast("array<string>")
    x = match(rows, alias_index(state), state) if titled else match(rows, alias_index(state)).withColumn("reused", F.lit(False))
    x = x.join(state.select("state_id", "first_seen", "times_seen", F.col("last_snapshot").alias("old"), F.col("aliases").alias("old_aliases")), "state_id", "left")
    claim = {"strong": _ranked(0, 1), "core": title_core(F.col("snapshot.title")) if titled else F.lit("")}
    matched = staged(x)
    x = matched.withColumns(claim)
    found = staged(splits(x.select("state_id", "ord", "strong", _ranked(0, 0).alias("ids"), _ranked(1, 1).alias("urls"), F.array_intersect("strong", F.coalesce("old_aliases", none)).alias("held"), "core")))
    gone = found.where("gone IS NOT NULL").groupBy("state_id", F.col("parent").alias("part")).agg(F.flatten(F.collect_list("gone")).alias("gone"))
    # Only records that share a state row have others before them and may be split; the rest, most of them, need not be moved.
    several = staged(matched.where("state_id IS NOT NULL").groupBy("state_id").agg(F.count("*").alias("n")).where("n > 1").select("state_id"))
    names = rows.schema["snapshot"].dataType.names
    nothing = F.lit(None).cast(rows.schema["snapshot"].dataType)
    run = Window.partitionBy("state_id", "part").orderBy("ord")
    earlier = F.last(F.when(F.col("snapshot.resolved"), F.col("snapshot")), ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, -1)) if "resolved" in names else nothing
    many = x.join(several, "state_id", "left_semi").join(found.select(*_CLAIM, "part", "seed"), list(_CLAIM), "left").withColumn("part", F.coalesce("part", F.lit(0))).join(gone, ["state_id", "part"], "left").drop(*claim)
    many = many.withColumns({"was": F.lag("snapshot").over(run), "head": F.min("ord").over(run), "earlier": earlier})
    alone = matched.join(several, "state_id", "left_anti").withColumns({"part": F.lit(0), "seed": F.lit(None).cast("string"), "gone": F.lit(None).cast("array<string>"), "was": nothing, "head": F.col("ord"), "earlier": nothing})
    x = alone.unionByName(many)

    known = F.col("first_seen").isNotNull()
    mine = F.when(F.col("part") == 0, F.col("old"))
    x = x.withColumn("known", known).withColumn("was", F.coalesce(F.when(known, F.col("was")), mine))
    if "resolved" in names:
        x = x.withColumn("trusted", F.coalesce(F.when(known, F.col("earlier")), F.when(mine["resolved"], mine)))
        x = x.withColumn("old", F.when(F.col("was").isNotNull(), stored(F.col("was"), F.col("trusted"), names)))
        x = x.withColumn("stored", stored(F.col("snapshot"), F.when(F.col("old.resolved"), F.col("old")), names))
        found_before, found_now = (F.coalesce(F.col(f"{c}.resolved"), F.lit(False)) for c in ("old", "snapshot"))
        degraded, event = found_before & ~found_now, F.when(F.col("old").isNotNull(), quality_event(found_before, found_now))
    else:
        x = x.withColumn("old", F.col("was")).withColumn("stored", F.col("snapshot"))
        degraded, event = F.lit(False), F.lit(None).cast("string")
    x = x.withColumn("degraded", degraded).withColumn("state_events", F.array_compact(F.array(event)))
    both = F.col("old.resolved") & F.col("snapshot.resolved") if {"resolved", "recommendation", "simhash"} <= set(names) else None
    reasons = F.when(F.col("old").isNotNull(), change_reasons("old", "snapshot", fields, degraded=F.col("degraded"), both_resolved=both)).otherwise(none)
    url = F.array_min(_ranked(1, 1))
    first = F.when(F.col("reused") & url.isNotNull(), url).otherwise(F.coalesce(F.try_element_at(F.transform("aliases", lambda a: a["alias"]), F.lit(1)), F.to_json("snapshot")))
    base = F.when(known & (F.col("part") == 0), F.col("state_id")).otherwise(state_id(F.coalesce("seed", first)))
    x = x.withColumn("change_reasons", reasons).withColumn("fresh", ~known | (F.col("part") > 0)).withColumn("base", base)
    status = transition(F.col("known"), F.col("old.application_status"), F.col("snapshot.application_status"), F.col("change_reasons"), F.col("degraded"))
    seen = staged(x.withColumn("seen_status", status).select(*rows.columns, "seen_status", "change_reasons", "state_events", "base", "fresh", "head", "part", "old_aliases", "gone", "first_seen", "times_seen", "stored"))
    dropped(matched, found, several)
    # An id that is taken or given twice is numbered; only those are kept, by their record.
    new = seen.where("fresh").groupBy("base", "head").agg(F.lit(1).alias("_one"))
    taken = state.groupBy(F.regexp_replace("state_id", "^(job_[0-9a-f]{20})_[0-9]+$", "$1").alias("base")).agg(F.count("*").alias("taken"))
    nth = F.dense_rank().over(Window.partitionBy("base").orderBy("head")) - 1 + F.coalesce("taken", F.lit(0))
    numbers = staged(new.join(taken, "base", "left").select("base", "head", F.lit(True).alias("fresh"), nth.alias("nth")).where("nth > 0"))
    new_id = F.when(F.col("nth").isNull(), F.col("base")).otherwise(F.concat("base", F.lit("_"), F.col("nth").cast("string")))
    seen = seen.join(numbers, ["base", "head", "fresh"], "left").withColumn("state_id", new_id).drop("nth")
    own = F.transform("aliases", lambda a: a["alias"])
    before = F.when(F.col("part") == 0, F.col("old_aliases"))
    now = seen.groupBy("state_id").agg(
        F.array_distinct(F.concat(F.array_except(F.coalesce(F.first(before), none), F.coalesce(F.first("gone"), none)), F.flatten(F.collect_list(own)))).alias("aliases"), F.coalesce(F.first("first_seen"), day).alias("first_seen"), day.alias("last_seen"),
        (F.coalesce(F.first(F.when(F.col("part") == 0, F.col("times_seen"))), F.lit(0)) + F.count("*")).cast("int").alias("times_seen"), F.max_by("stored", "ord").alias("last_snapshot"),
    )
    kept = state.join(now.select("state_id"), "state_id", "left_anti")
    return seen.select(*rows.columns, "state_id", "seen_status", "change_reasons", "state_events"), kept.unionByName(now)
