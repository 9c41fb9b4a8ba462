"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents are added up by the set of sources that they belong to. Each source gets a quota of words by its weight, none
more than its own words repeated so often (water filling). A flow takes the words of the patterns to the quotas; a
pattern's words can be taken several times, and each repetition costs more than the one before, so words are repeated only
where a source has no fresh ones. What a pattern gives is then taken from its documents: all of them as often as the words
suffice, and once more those that come first in a seeded order; the last of these is cut, so that the words add up.

The seeded order is not sorted: counts by the first digits of the documents' hashes, level by level, lead to the one bucket
of each pattern in which the words run out, and only that one is gone through in order.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

WEIGHTS, REPEATS, SEED = (5, 2, 1), 3, "mix-1"
#: Levels of the seeded order, of two hexadecimal digits each.
LEVELS = 3
WORD = r"[^\x20\x09-\x0D]+"
_PLAN = "pattern array<string>, whole long, prefix string, part long, sources array<struct<source: string, size: long, target: double>>"
#: Patterns that are broadcast at most.
BROADCAST = 10_000


def fill(sizes: list[int], weights: list[int], total: int, repeats: int = REPEATS) -> list[float]:
    """Targets that share the total by weight, none above repeats times its size.

    With the least size a weight first, sources reach their limit one after the other as the level rises, until the rest
    can take what is left.
    """
    out, left, weight = [0.0] * len(sizes), total, sum(weights)
    ascending = sorted(range(len(sizes)), key=lambda i: Fraction(sizes[i], weights[i]))
    for n, i in enumerate(ascending):
        if left * weights[i] <= repeats * sizes[i] * weight:
            for k in ascending[n:]:
                out[k] = left * weights[k] / weight
            break
        out[i] = float(repeats * sizes[i])
        left, weight = left - repeats * sizes[i], weight - weights[i]
    return out


def flow(patterns: dict[tuple[str, ...], int], quotas: dict[str, int], repeats: int = REPEATS) -> dict[tuple[tuple[str, ...], str], int]:
    """Words that each pattern gives each of its sources: as many of the quotas as can be met, with the fewest repetitions.

    Words of the r-th repetition of a pattern cost r. Shortest augmenting paths in the residual graph keep the flow of least
    cost for its size. A source of one pattern, that is of no other source, needs no path.
    """
    given: dict[tuple[tuple[str, ...], str], int] = {}
    used, left, of = dict.fromkeys(patterns, 0), dict(quotas), defaultdict(list)
    for p in patterns:
        for s in p:
            of[s].append(p)
    for s, ps in of.items():
        if len(ps) == 1 and len(ps[0]) == 1:
            used[ps[0]] = given[ps[0], s] = min(left[s], repeats * patterns[ps[0]])
            left[s] = 0
    for s in sorted(of):
        while left.get(s, 0):
            path = _cheapest(s, of, patterns, used, given, repeats)
            if path is None:
                break
            last = path[-1]
            amount = min([left[s], patterns[last] * (used[last] // patterns[last] + 1) - used[last], *(given[path[i], path[i + 1]] for i in range(1, len(path) - 1, 2))])
            for i in range(0, len(path) - 1, 2):
                given[path[i + 1], path[i]] = given.get((path[i + 1], path[i]), 0) + amount
                if i:
                    given[path[i - 1], path[i]] -= amount
            used[last] += amount
            left[s] -= amount
    return {k: v for k, v in given.items() if v}


def _cheapest(source: str, of: dict, patterns: dict, used: dict, given: dict, repeats: int) -> list | None:
    """source, pattern, source, pattern ...: words of each pattern go to the source before it; the last has words to spare.

    Moving words from one source to another is free, so the path's cost is that of the last pattern's next repetition, and
    any path to a pattern of the cheapest repetition will do.
    """
    back, todo, best, at = {source: None}, deque([source]), repeats, None
    while todo and best:
        s = todo.popleft()
        for p in of[s]:
            if p in back or not patterns[p]:
                continue
            back[p] = s
            if used[p] // patterns[p] < best:
                best, at = used[p] // patterns[p], p
            for other in p:
                if other not in back and given.get((p, other)):
                    back[other] = p
                    todo.append(other)
    if at is None:
        return None
    path = [at]
    while back[path[0]] is not None:
        path.insert(0, back[path[0]])
    return path


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _mark(source: Column) -> Column:
    """A string for every source; null is one too and sorts last."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("~"))


def _few(df: DataFrame, patterns: int) -> DataFrame:
    """df has a row for each pattern at most, so its size is known; where they are too many to be broadcast, adaptive execution
    splits the skewed ones."""
    return F.broadcast(df) if patterns <= BROADCAST else df


def _cutoffs(rows: DataFrame, asked: DataFrame, patterns: int) -> DataFrame:
    """(pattern, prefix, rest): in the seeded order documents before the prefix are taken once more, after it none, and of
    those of the prefix so many words as rest says."""
    at = asked.withColumn("prefix", F.lit(""))
    for level in range(LEVELS):
        inside = rows.select("pattern", "size", F.substring("order", 1, 2 * level).alias("prefix"), F.substring("order", 2 * level + 1, 2).alias("digit")).join(_few(at, patterns), ["pattern", "prefix"])
        sums = inside.groupBy("pattern", "prefix", "digit").agg(F.sum("size").alias("own"), F.first("rest").alias("rest"))
        up = F.sum("own").over(Window.partitionBy("pattern").orderBy("digit"))
        sums = sums.withColumn("upto", up).filter("upto >= rest AND upto - own < rest")
        at = stage(sums.select("pattern", (F.col("rest") - F.col("upto") + F.col("own")).alias("rest"), F.concat("prefix", "digit").alias("prefix")), f"mix-level{level}")
    return at


def mix(docs: DataFrame, key: str, sources: Column, size: Column, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """(key, size, sources, taken) of every document: its words, those of it that the mix takes, and of each of its sources
    the words and the target.

    sources: array of the sources that a document belongs to. Sources in the order of their code points, null last, have the
    weights, repeating; the targets share the words of all documents. A source's words are those of all its documents. Quotas
    are the targets rounded to whole words. The driver holds a number for each pattern of sources, never documents.

    A document with no source (an empty or null array) gives nothing and is counted in the total. Null sizes count as 0;
    documents of no words give none. Rows of equal key, pattern and size are interchangeable. Other columns, whatever their
    names, are not read. An empty table gives an empty result. The same rows give the same mix in any partitioning.
    """
    marks = F.array_sort(F.array_distinct(F.transform(F.coalesce(sources, F.array().cast("array<string>")), _mark)))
    rows = docs.select(F.col(key).alias("_key"), marks.alias("pattern"), F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    rows = stage(rows.withColumn("order", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_key").cast("string"), F.lit(""))))), "mix-rows")
    sums = {tuple(r["pattern"]): r["size"] for r in rows.groupBy("pattern").agg(F.sum("size").alias("size")).collect()}
    of = defaultdict(int)
    for p, n in sums.items():
        for s in p:
            of[s] += n
    names = sorted(of, key=lambda s: (s == "~", s.encode()))
    targets = dict(zip(names, fill([of[s] for s in names], [weights[i % len(weights)] for i in range(len(names))], sum(sums.values()), repeats), strict=True))
    given = defaultdict(int)
    for (p, _), n in flow({p: n for p, n in sums.items() if p}, {s: math.floor(t + 0.5) for s, t in targets.items()}, repeats).items():
        given[p] += n
    spark = docs.sparkSession
    plan = {p: (given[p] // n, given[p] % n) if n else (0, 0) for p, n in sums.items()}
    asked = spark.createDataFrame([(list(p), rest) for p, (_, rest) in plan.items() if rest], "pattern array<string>, rest long")
    cut = {tuple(r["pattern"]): (r["prefix"], r["rest"]) for r in _cutoffs(rows, asked, len(plan)).collect()}
    info = {p: [(None if s == "~" else s[1:], of[s], targets[s]) for s in p] for p in sums}
    whole = spark.createDataFrame([(list(p), times, *cut.get(p, (None, None)), info[p]) for p, (times, _) in plan.items()], _PLAN)
    rows = rows.join(_few(whole, len(plan)), "pattern")
    at = F.substring("order", 1, 2 * LEVELS)
    last = at.eqNullSafe(F.col("prefix"))
    before = F.sum("size").over(Window.partitionBy("pattern").orderBy("order", "_key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    edge = rows.filter(last).withColumn("more", F.greatest(F.least(F.col("size"), F.col("part") - before), F.lit(0)))
    rest = rows.filter(~last).withColumn("more", F.when(at < F.col("prefix"), F.col("size")).otherwise(F.lit(0)))
    return edge.unionByName(rest).select(F.col("_key").alias(key), "size", "sources", (F.col("whole") * F.col("size") + F.col("more")).alias("taken"))


def document_mix(docs: DataFrame) -> DataFrame:
    """mix() of documents by their one source each."""
    return mix(docs, "doc_id", F.array("source"), words(F.col("text")))


def oracle_sql() -> str:
    """document_mix() in DuckDB: with one source a document, a source's flow is its quota."""
    return f"""
WITH t AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS size, [{", ".join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS w FROM t GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY size::DOUBLE / w, source NULLS LAST) AS i FROM s),
l AS (SELECT *, (sum(size) OVER () - coalesce(sum({REPEATS} * size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS free, (sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weight FROM r),
k AS (SELECT min(i) AS i FROM l WHERE free * w <= {REPEATS} * size * weight),
g AS (SELECT l.source, l.size, CASE WHEN l.i < k.i THEN {REPEATS} * l.size::DOUBLE ELSE (e.free * l.w)::DOUBLE / e.weight END AS target FROM l, k, l AS e WHERE e.i = k.i),
q AS (SELECT *, floor(target + 0.5)::BIGINT AS quota FROM g),
d AS (SELECT t.doc_id, t.size, q.size AS source_size, q.target, q.quota, sum(t.size) OVER (PARTITION BY t.source ORDER BY md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, t.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - t.size AS before FROM t JOIN q ON t.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE quota // source_size * size + greatest(least(size, quota % source_size - before), 0) END::BIGINT AS taken FROM d
"""
