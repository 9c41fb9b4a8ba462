"""Hard negatives of anchors by inner product, with a table of pivot distances.

Every vector gets one more component, the root of what its square falls short of the largest square, so that all have one
length; an anchor, as a query, gets a zero. Then |q - v|^2 = |q|^2 + M^2 - 2 <q, v>: the nearest vector has the largest inner
product. The table stores each vector's distances to PIVOTS pivots. By the triangle inequality an anchor's own distances to
the pivots bracket its distance to every stored vector, and so their inner product, without a look at the vector. Vectors
whose bracket can't reach what is asked for are passed over; the rest are checked exactly, in whole numbers.

Anchors and vectors meet in tiles: a tile holds at most about BLOCK vectors and CHUNK anchors, dealt by hashes of the ids.
Positives are looked for in tiles of one label, negatives in tiles of all. A tile hands on the best few of each anchor.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Pivots, and the vectors (of the least hashes) among which they are chosen, each as far as possible from those before.
PIVOTS, SAMPLE = 16, 1024
#: Vectors and anchors of a tile.
BLOCK, CHUNK = 4096, 4096
#: Share of the squared lengths by which brackets are widened for rounding.
SLACK = 1e-9
_LONG = np.iinfo(np.int64)
_TILE = "id long, label long, vector array<long>, dist array<double>, positives array<struct<id: long, score: long>>, query boolean"
_BEST = "anchor_id long, positive_id long, positive_score long, ids array<long>, scores array<long>"


def _matrix(column: pa.ChunkedArray | pa.Array, width: int, kind: type) -> np.ndarray:
    """A row for each list; shorter ones end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (size == width).all():
        return flat.reshape(-1, width).astype(kind)
    out = np.zeros((len(size), width), kind)
    out[np.arange(width) < size[:, None]] = flat
    return out


def _squares(m: np.ndarray) -> np.ndarray:
    return (m.astype(np.float64) ** 2).sum(axis=1)


def choose(sample: np.ndarray, most: float, pivots: int = PIVOTS) -> np.ndarray:
    """Pivots out of the sample's augmented vectors: the first, then always the one farthest from those chosen."""
    points = augmented(sample, most)
    chosen, far = [0], np.full(len(points), np.inf)
    while len(chosen) < min(pivots, len(points)):
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        if not far.max():
            break
        chosen.append(int(far.argmax()))
    return points[chosen]


def augmented(vectors: np.ndarray, most: float) -> np.ndarray:
    """One more component, so that all squared lengths are most."""
    return np.column_stack([vectors.astype(np.float64), np.sqrt(np.maximum(most - _squares(vectors), 0))])


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.column_stack([np.sqrt(((points - p) ** 2).sum(axis=1)) for p in pivots]) if len(points) else np.zeros((0, len(pivots)))


class Tile:
    """Vectors with their pivot distances, asked by one anchor after the other."""

    def __init__(self, rows: pa.Table, width: int, pivots: np.ndarray, most: float):
        query = rows["query"].to_numpy()
        points, self.queries = rows.filter(~query), rows.filter(query)
        self.ids, self.labels = points["id"].to_numpy(), points["label"].to_numpy()
        self.vectors = _matrix(points["vector"], width, np.int64)
        self.plain = self.vectors.astype(np.float64)
        self.dist = np.ascontiguousarray(_matrix(points["dist"], len(pivots), np.float64).T)
        self.most, self.largest = most, float(np.abs(self.plain).max(initial=0))
        self.asked = _matrix(self.queries["vector"], width, np.int64)
        self.squares = _squares(self.asked)
        self.far = distances(np.column_stack([self.asked.astype(np.float64), np.zeros(len(self.asked))]), pivots)

    def brackets(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest inner product that the pivots allow each vector with anchor i."""
        near, far = np.zeros(len(self.ids)), np.full(len(self.ids), np.inf)
        for stored, own in zip(self.dist, self.far[i], strict=True):
            np.maximum(near, np.abs(stored - own), out=near)
            np.minimum(far, stored + own, out=far)
        both = self.squares[i] + self.most
        slack = SLACK * both + 1e-6
        return (both - far**2) / 2 - slack, (both - near**2) / 2 + slack

    def exact(self, i: int, at: np.ndarray) -> np.ndarray:
        """Inner products with anchor i in whole numbers; beyond 64 bits the nearest number of 64 bits."""
        q = self.asked[i]
        if self.largest * float(np.abs(q.astype(np.float64)).max(initial=0)) * max(len(q), 1) < 2**53:
            plain = q.astype(np.float64)
            return (self.plain @ plain)[at].astype(np.int64) if 2 * len(at) > len(self.ids) else (self.plain[at] @ plain).astype(np.int64)
        found = self.vectors[at].astype(object) @ q.astype(object)
        return np.array([min(max(int(x), _LONG.min), _LONG.max) for x in found], np.int64)

    def positives(self, i: int, anchor: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best vectors but the anchor itself, best first. All of the tile have the anchor's label."""
        others = np.flatnonzero(self.ids != anchor)
        _, high = self.brackets(i)
        if len(others) > 2 * most:
            first = others[np.argpartition(high[others], -2 * most)[-2 * most :]]
            reached = np.partition(self.exact(i, first), -most)[-most]
            others = others[high[others] >= reached]
        scores = self.exact(i, others)
        best = np.lexsort((self.ids[others], ~scores))[:most]  # ~ turns the order round and can't overflow
        return self.ids[others[best]], scores[best]

    def negatives(self, i: int, label: int, positives: list[dict], low: int, high: int, most: int) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
        """For each positive (ids, scores) of the best vectors of other labels whose score lies between low and high
        hundredths of the positive's, best first."""
        spans = [(-(-low * p["score"] // 100), high * p["score"] // 100) for p in positives]
        spans = [(p, a, b) for p, (a, b) in zip(positives, spans, strict=True) if a <= b]
        if not spans:
            return
        least, largest = self.brackets(i)
        at = np.flatnonzero((self.labels != label) & (largest >= min(a for _, a, _ in spans)) & (least <= max(b for _, _, b in spans)))
        scores = self.exact(i, at)
        down = np.lexsort((self.ids[at], scores))  # ascending in both
        at, scores = at[down], scores[down]
        for p, a, b in spans:
            lo, hi = np.searchsorted(scores, a, "left"), np.searchsorted(scores, b, "right")
            first = max(lo, hi - most)
            first = np.searchsorted(scores, scores[first], "left") if lo < hi else first  # all that tie with the last one
            first = max(first, lo)
            ids, own = self.ids[at[first:hi]], scores[first:hi]
            best = np.lexsort((ids, ~own))[:most]
            if len(best):
                yield p, ids[best], own[best]


def _best(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    names = ("anchor_id", "positive_id", "positive_score", "ids", "scores")
    return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def _top(found: DataFrame, most: int, *group: str) -> DataFrame:
    """The best of each group out of what the tiles found: (group, rank, id, score)."""
    each = found.select(*group, F.explode(F.arrays_zip("ids", "scores")).alias("x")).select(*group, F.col("x.ids").alias("id"), F.col("x.scores").alias("score"))
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "id")
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def _dealt(column: str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(column), parts).cast("int")


def _all(parts: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), (parts - 1).cast("int")))


def mine(df: DataFrame, key: str, label: Column, vector: Column, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that are anchors.

    vector: whole numbers. A row's score is its inner product with the anchor; higher ones come first, ties by the smaller
    key. An anchor's positives are its first so many other rows of its label. For each of them the first so many rows of
    other labels come back whose score lies between low and high hundredths of the positive's, with their rank from 1. An
    anchor without positives, or a positive without such rows, gives none. A positive of negative score has none.

    Rows without key, label or vector, or with a null among the components, take no part. Of rows that share a key one takes
    part: that of the least label, then of the least vector. Vectors that are shorter than the longest end in zeros. Scores
    beyond 64 bits count as the nearest number of 64 bits. Other columns, whatever their names, are not read. An empty table
    gives an empty result.
    """
    named = df.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), vector.cast("array<long>").alias("vector"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    whole = named.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", F.isnull))
    rows = stage(whole.groupBy("id").agg(F.min(F.struct("label", "vector", "anchor")).alias("r")).select("id", "r.*"), "negatives-rows")
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, asking, width, most = rows.agg(F.count("*"), F.count_if("anchor"), F.coalesce(F.max(F.size("vector")), F.lit(0)), F.coalesce(F.max(square), F.lit(0.0))).first()
    sample = rows.select("vector").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    pivots = choose(_matrix(pa.array([r["vector"] for r in sample], pa.list_(pa.int64())), width, np.int64), most) if sample else np.zeros((0, width + 1))

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = distances(augmented(_matrix(b.column("vector"), width, np.int64), most), pivots)
            dist = pa.ListArray.from_arrays(np.arange(len(far) + 1, dtype=np.int32) * len(pivots), far.ravel())
            yield b.append_column("dist", dist)

    table = stage(rows.mapInArrow(stored, "id long, label long, vector array<long>, anchor boolean, dist array<double>"), "negatives-pivots")
    point = [F.col("dist"), F.lit(None).cast("array<struct<id: long, score: long>>").alias("positives"), F.lit(False).alias("query")]

    def best_of_label(rows: pa.Table) -> pa.Table:
        tile = Tile(rows, width, pivots, most)
        ids = tile.queries["id"].to_pylist()
        return _best([(a, None, None, *tile.positives(i, a, positives)) for i, a in enumerate(ids)])

    def best_of_others(rows: pa.Table) -> pa.Table:
        tile = Tile(rows, width, pivots, most)
        ids, labels, known = (tile.queries[c].to_pylist() for c in ("id", "label", "positives"))
        return _best([(a, p["id"], p["score"], x, s) for i, a in enumerate(ids) for p, x, s in tile.negatives(i, labels[i], known[i], low, high, negatives)])

    tiles = lambda rows, limit: F.greatest(F.lit(1), F.ceil(rows / limit)).cast("int")
    labels = table.groupBy("label").agg(tiles(F.count("*"), BLOCK).alias("blocks"), tiles(F.count_if("anchor"), CHUNK).alias("chunks"), F.count_if("anchor").alias("asking")).filter("asking > 0")
    sized = table.join(labels, "label")
    block, chunk = F.col("blocks"), F.col("chunks")
    points = sized.select("label", "id", "vector", *point, _dealt("id", block).alias("b"), _all(chunk).alias("c"))
    asks = sized.filter("anchor").select("label", "id", "vector", F.lit(None).cast("array<double>").alias("dist"), *point[1:-1], F.lit(True).alias("query"), _dealt("id", chunk).alias("c"), _all(block).alias("b"))
    found = points.unionByName(asks).groupBy("label", "b", "c").applyInArrow(lambda rows: best_of_label(rows), _BEST)
    own = _top(found, positives, "anchor_id").groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("best"))
    known = stage(own.select(F.col("anchor_id").alias("id"), F.transform("best", lambda x: F.struct(x["id"], x["score"])).alias("positives")), "negatives-positives")

    blocks, chunks = (F.lit(max(1, math.ceil(x / y))) for x, y in ((n, BLOCK), (asking, CHUNK)))
    points = table.select("id", "label", "vector", *point, _dealt("id", blocks).alias("b"), _all(chunks).alias("c"))
    asks = table.filter("anchor").join(known, "id").select("id", "label", "vector", F.lit(None).cast("array<double>").alias("dist"), "positives", F.lit(True).alias("query"), _dealt("id", chunks).alias("c"), _all(blocks).alias("b"))
    found = points.unionByName(asks).groupBy("b", "c").applyInArrow(lambda rows: best_of_others(rows), _BEST)
    out = _top(found, negatives, "anchor_id", "positive_id", "positive_score")
    return out.select(F.col("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def of_embeddings(embeddings: DataFrame) -> DataFrame:
    """mine() over embeddings: components in 256ths, rounded down; every hundredth id is an anchor; of every seventh the label
    is moved on by one (modulo ten), so that alike vectors of different labels exist. A component that is not a finite number
    takes its row out."""
    third = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    finite = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double")) < math.inf, F.floor(x.cast("double") * 256)))
    return mine(embeddings, "vec_id", third, finite, F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT a.vec_id AS anchor_id, a.label, a.v, o.vec_id AS positive_id, list_inner_product(a.v, o.v)::BIGINT AS positive_score
  FROM r a JOIN r o ON a.label = o.label AND a.vec_id <> o.vec_id WHERE a.vec_id % 100 = 0
  QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.v, o.v) DESC, o.vec_id) <= 5),
s AS (SELECT a.vec_id AS anchor_id, o.vec_id AS negative_id, list_inner_product(a.v, o.v)::BIGINT AS negative_score FROM r a JOIN r o ON a.label <> o.label WHERE a.vec_id % 100 = 0)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id)::INTEGER AS rank, negative_id, positive_score, negative_score
FROM p JOIN s USING (anchor_id) WHERE 100 * negative_score BETWEEN 30 * positive_score AND 90 * positive_score
QUALIFY rank <= 10
"""
