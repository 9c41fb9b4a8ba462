"""Jaccard join of word shingles by chosen paths.

Each set walks RUNS random trees. In a node it follows the branches of those of its tokens whose hash, with the node's
path, is below 1 / (LAMBDA |set|): 1 / LAMBDA branches on average, and two sets of similarity LAMBDA or more follow at
least one common branch on average. Nodes with few sets are compared by brute force; larger ones are split by their
children, down to LEVELS levels. Sets that only share a passage or a frequent line part ways on the next level; near
copies stay together. RUNS repeats bring the recall above TARGET at the similarity LAMBDA (see recall()), and closer
pairs higher.

Texts with equal sets are one class from the start and take part once. In a bucket, pairs are screened by sketches, and
the rest compared exactly. A pair that meets in several buckets counts in the first of them only, which each bucket finds
from its members' lists of buckets; so a bucket hands on sums and a spanning forest, never its pairs. Large buckets at
the last level are compared in tiles of bounded size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks, released, stage
from .shingles import mix, shingle_sets

SHINGLE, SIMILARITY = 5, 0.8
LAMBDA, RUNS, LEVELS, TARGET = 0.8, 12, 3, 0.99
#: Sets in a bucket that is compared without a further split, and in half a tile of one that can't be split.
SMALL, TILE = 100, 400
#: Bins of a sketch, and standard errors that it may fall short of the similarity.
BINS, ERRORS = 64, 4.0
#: Bytes of texts handled at a time.
CHUNK = 1_000_000
#: Buckets looked at together when a tile's members are asked whether they met before.
COLUMNS = 4096
_SIG = "sig binary"


def recall(similarity: float = SIMILARITY, runs: int = RUNS, levels: int = LEVELS) -> float:
    """Expected recall of pairs that are only separated on the last level (Poisson branches)."""
    p = 1.0
    for _ in range(levels):
        p = 1 - math.exp(-similarity / LAMBDA * p)
    return 1 - (1 - p) ** runs


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start[i] .. start[i] + size[i] - 1, one range after the other."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


def paths(tokens: np.ndarray, size: np.ndarray, runs: int = RUNS, levels: int = LEVELS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level, sorted by set: the set, the parent's position among the set's nodes of the level above, the path."""
    start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    share = np.minimum(1.0, 1 / (LAMBDA * np.maximum(size, 1)))
    below = np.where(share >= 1, np.uint64(2**64 - 1), (share * 2.0**64 * (1 - 2**-52)).astype(np.uint64))
    nodes: list[list[tuple]] = [[] for _ in range(levels)]
    reached = [0] * levels
    for run in range(runs):
        at = np.flatnonzero(size)
        path, number = np.full(len(at), mix(np.array([run + 1], dtype=np.uint64))[0]), np.zeros(len(at), dtype=np.int64)
        for level in range(levels):
            of = np.repeat(np.arange(len(at)), size[at])
            token = tokens[_ragged(start[at], size[at])]
            drawn = mix(mix(token) ^ path[of])
            hit = np.flatnonzero(drawn <= below[at][of])
            at, parent, path = at[of[hit]], number[of[hit]], mix(drawn[hit] + path[of[hit]] * np.uint64(3))
            number = reached[level] + np.arange(len(at))
            reached[level] += len(at)
            nodes[level].append((at, parent, path))
    out, place = [], np.zeros(1, dtype=np.int64)
    for level in nodes:
        at, parent, path = (np.concatenate([x[k] for x in level]) for k in range(3))
        order = np.argsort(at, kind="stable")
        first = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(size)))]).astype(np.int64)
        out.append((at[order], place[parent[order]], path[order]))
        place = np.zeros(len(at), dtype=np.int64)
        place[order] = np.arange(len(at)) - first[at[order]]
    return out


def sketches(tokens: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One-permutation minhash: a byte for each bin, 0 where the set has no token."""
    out = np.zeros((len(size), BINS), dtype=np.uint8)
    of = np.repeat(np.arange(len(size)), size)
    bin_ = (tokens >> np.uint64(46)).astype(np.int64)
    slot = of * BINS + bin_
    first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])) if len(slot) else slot
    out.reshape(-1)[slot[first]] = 1 + (mix(tokens[first]) % np.uint64(255)).astype(np.uint8)
    return out


def _signature(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _lists(at: np.ndarray, n: int, path: np.ndarray, parent: np.ndarray | None = None) -> pa.Array:
    """A list for each of n sets of its nodes: paths, or structs of the parent's position p and the path q."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(at, minlength=n))]).astype(np.int32))
    q = pa.array(path.view(np.int64))
    return pa.ListArray.from_arrays(offsets, q if parent is None else pa.StructArray.from_arrays([pa.array(parent.astype(np.int32)), q], names=["p", "q"]))


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int = SHINGLE) -> DataFrame:
    """id, text, sig, size, sketch, k1 (paths), k2, k3 (position p of the parent in the list above, and path q) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in byte_chunks(batch.column(1), CHUNK):
                n = len(part)
                tokens, size = shingle_sets(part, k)
                ends = np.cumsum(size)
                levels = paths(tokens, size)
                columns = [batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array([_signature(x) for x in np.split(tokens, ends[:-1])], type=pa.binary()), pa.array(size, type=pa.int64()), pa.array([x.tobytes() for x in sketches(tokens, size)], type=pa.binary())]
                columns += [_lists(levels[0][0], n, levels[0][2]), *(_lists(at, n, path, parent) for at, parent, path in levels[1:])]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "text", "sig", "size", "sketch", "k1", "k2", "k3"])

    pair = "array<struct<p:int,q:bigint>>"
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, text string, {_SIG}, size long, sketch binary, k1 array<bigint>, k2 {pair}, k3 {pair}")


def _children(sets: DataFrame, depth: int) -> DataFrame:
    """(sig, p, bucket): the nodes of the level below depth, with their parents' paths."""
    above = F.col("k1") if depth == 1 else F.transform(f"k{depth}", lambda x: x["q"])
    below = F.transform(f"k{depth + 1}", lambda x: F.struct(F.get(above, x["p"]).alias("p"), x["q"].alias("q")))
    return sets.select("sig", F.explode(below).alias("k")).select("sig", "k.p", F.col("k.q").alias("bucket"))


def buckets(sets: DataFrame, small: int = SMALL) -> DataFrame:
    """(sig, bucket, n): the buckets in which each set is to be compared, and their sizes.

    Each level's nodes and sizes are staged, since the nodes in use and the next level both depend on them.
    """
    out = []
    level = sets.select("sig", F.explode("k1").alias("bucket"))
    for depth in range(1, LEVELS + 1):
        sizes = stage(level.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "jaccard-sizes")
        out.append(level.join(sizes if depth == LEVELS else sizes.where(F.col("n") <= small), "bucket").select("sig", "bucket", "n"))
        if depth < LEVELS:
            large = sizes.where(F.col("n") > small).select(F.col("bucket").alias("p"))
            level = stage(_children(sets, depth).join(large, "p").select("sig", "bucket"), "jaccard-level")
    return reduce(DataFrame.unionByName, out)


def _tiled(rows: DataFrame) -> DataFrame:
    """Add tile and side: members of a bucket of n sets are dealt into groups of about TILE, each pair of which is a tile."""
    groups = F.greatest(F.lit(1), F.ceil(F.col("n") / TILE)).cast("int")
    own = F.pmod(F.xxhash64("sig"), F.col("_g")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("_g") - 1), lambda j: F.struct((F.least(j, F.col("_o")) * F.col("_g") + F.greatest(j, F.col("_o"))).alias("tile"), F.when(j == F.col("_o"), 2).when(F.col("_o") < j, 0).otherwise(1).alias("side")))
    return rows.withColumn("_g", groups).withColumn("_o", own).withColumn("_t", F.explode(tiles)).select("*", "_t.tile", "_t.side").drop("_g", "_o", "_t")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of the rows with equal (bucket, tile), which must follow each other."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        b, t = batch.column("bucket").to_numpy(), batch.column("tile").to_numpy()
        cuts = np.flatnonzero((b[1:] != b[:-1]) | (t[1:] != t[:-1])) + 1
        for i, j in zip([0, *cuts], [*cuts, len(b)], strict=True):
            key = (b[i], t[i])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _owned(group: pa.Table) -> np.ndarray:
    """Which pairs of members are this tile's to compare: those that share no earlier bucket, of sizes that allow a link."""
    side, size, bucket = group["side"].to_numpy(), group["size"].to_numpy(), group["bucket"][0].as_py()
    lists = group["all"].combine_chunks()
    of = np.repeat(np.arange(len(side)), np.diff(lists.offsets.to_numpy()))
    value = lists.values.to_numpy()[lists.offsets.to_numpy()[0] : lists.offsets.to_numpy()[-1]]
    before = value < bucket
    _, code = np.unique(value[before], return_inverse=True)
    row, n = of[before], int(code.max()) + 1 if len(code) else 0
    if n > COLUMNS:
        # A bucket of one member tells of no pair; the others are taken in runs of COLUMNS.
        shared = np.bincount(code) > 1
        row, code, n = row[shared[code]], (np.cumsum(shared) - 1)[code[shared[code]]], int(shared.sum())
        order = np.argsort(code, kind="stable")
        row, code = row[order], code[order]
    own = np.triu(np.ones((len(side), len(side)), dtype=bool), 1)
    for first in range(0, n, COLUMNS):
        a, b = np.searchsorted(code, [first, first + COLUMNS]) if n > COLUMNS else (0, len(code))
        met = np.zeros((len(side), min(COLUMNS, n - first)), dtype=np.float32)
        met[row[a:b], code[a:b] - first] = 1
        own &= (met @ met.T) == 0
    if (side != 2).any():
        own &= side[:, None] != side  # within a group the pairs belong to the group's own tile
    return own & (np.minimum(size[:, None], size) >= SIMILARITY * np.maximum(size[:, None], size))


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the members that, by their sketches, may be similar to another."""
    for group in _groups(batches):
        own = _owned(group)
        flat = np.frombuffer(b"".join(group["sketch"].to_pylist()), dtype=np.uint8).reshape(-1, BINS)
        keep = np.zeros(len(flat), dtype=bool)
        for i in np.flatnonzero(own.any(1)):
            other = np.flatnonzero(own[i])
            same = (flat[other] == flat[i]) & (flat[i] > 0)
            some = np.maximum(((flat[other] > 0) | (flat[i] > 0)).sum(1), 1)
            may = same.sum(1) / some >= SIMILARITY - ERRORS * np.sqrt(SIMILARITY * (1 - SIMILARITY) / some)
            if may.any():
                keep[i] = True
                keep[other[may]] = True
        if keep.any():
            yield from group.filter(pa.array(keep)).drop_columns(["sketch"]).combine_chunks().to_batches()


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact similarities: each member's links in this tile, and a spanning forest of them."""
    for group in _groups(batches):
        own = _owned(group)
        tokens, size = [], group["size"].to_numpy()
        for _, part in ((0, part) for piece in group["text"].chunks for _, part in byte_chunks(piece, CHUNK)):
            tokens.append(shingle_sets(part, SHINGLE)[0])
        words, code = np.unique(np.concatenate(tokens), return_inverse=True)
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        links, root = np.zeros(len(size), dtype=np.int64), list(range(len(size)))
        sig, edges = group["sig"].to_pylist(), []

        def top(i: int, root: list[int] = root) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        mark = np.zeros(len(words), dtype=bool)
        for i in np.flatnonzero(own.any(1)):
            mine = code[start[i] : start[i] + size[i]]
            mark[mine] = True
            other = np.flatnonzero(own[i])
            hits = mark[code[_ragged(start[other], size[other])]]
            both = np.add.reduceat(hits, np.concatenate([[0], np.cumsum(size[other])[:-1]]), dtype=np.int64)
            mark[mine] = False
            linked = other[both * (1 + SIMILARITY) >= SIMILARITY * (size[i] + size[other]) - 1e-9]
            links[i] += len(linked)
            links[linked] += 1
            for j in linked.tolist():
                a, b = top(i), top(j)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    edges.append((sig[i], sig[j]))
        at = np.flatnonzero(links)
        left = [sig[i] for i in at] + [a for a, _ in edges]
        right = pa.array([None] * len(at) + [b for _, b in edges], type=pa.binary())
        n = np.concatenate([links[at], np.zeros(len(edges), dtype=np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(left, type=pa.binary()), right, pa.array(n)], names=["sig", "other", "links"])


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket", "tile").sortWithinPartitions("bucket", "tile")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the least node of its component.

    Alternating large-star and small-star steps; every round is written to the shared folder. Ends when nothing changes.
    """
    edges = stage(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = stage(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, class_id, n_links and copies of every row, similar texts in one class.

    Words are runs of anything but ASCII white space, A-Z in lower case; sets are of shingles of SHINGLE words. Two texts
    are linked if the Jaccard similarity of their sets is SIMILARITY or more; a class is a connected component of links,
    class_id the least id in it. n_links: the other distinct sets that a row's set is linked to. copies: rows with an equal
    set, itself included. A text of 1 to 4 words is one shingle. Texts without words (null, empty) have the empty set and
    are copies of each other, linked to nothing. Rows with equal ids are rows of their own; null ids come last for
    class_id. An empty table gives an empty result.
    """
    rows = stage(signatures(docs, id_col, text_col), "jaccard-sets")
    return _classes(rows).withColumnRenamed("id", id_col)


def _classes(rows: DataFrame) -> DataFrame:
    same = rows.groupBy("sig").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("k1").alias("k1"), F.first("k2").alias("k2"), F.first("k3").alias("k3"))
    sets = stage(same, "jaccard-distinct")
    met = buckets(sets).groupBy("sig").agg(F.collect_list(F.struct("bucket", "n")).alias("b"))
    members = met.join(sets.select("sig", "size", "sketch"), "sig").select("sig", "size", "sketch", F.col("b.bucket").alias("all"), F.explode("b").alias("e")).select("sig", "size", "sketch", "all", "e.bucket", "e.n")
    members = _dealt(_tiled(members).drop("n"))
    kept = stage(members.mapInArrow(released(_screen), members.drop("sketch").schema), "jaccard-screened")
    wanted = kept.select("sig").distinct()
    text = rows.select("sig", "text").join(wanted, "sig", "left_semi").groupBy("sig").agg(F.first("text").alias("text"))
    pairs = _dealt(kept.join(text, "sig"))
    found = stage(pairs.mapInArrow(released(_compare), "sig binary, other binary, links long"), "jaccard-links")
    links = found.where("other is null").groupBy("sig").agg(F.sum("links").alias("links"))
    roots = components(found.where("other is not null").select(F.col("sig").alias("a"), F.col("other").alias("b")))
    classes = sets.select("sig", "first_id", "copies").join(roots.withColumnRenamed("node", "sig"), "sig", "left").join(links, "sig", "left")
    least = classes.where("root is not null").groupBy("root").agg(F.min("first_id").alias("least"))
    classes = classes.join(least, "root", "left").select("sig", F.coalesce("least", "first_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), "copies")
    return rows.select("id", "sig").join(classes, "sig").select("id", "class_id", "n_links", "copies")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, with its columns, for each class: that with the least id.

    Repeated rows stay once; where texts of a class that differ share the least id, each of them stays.
    """
    found = join(docs, id_col, text_col)
    keep = found.where(F.col(id_col).eqNullSafe(F.col("class_id"))).select(F.col(id_col).alias("_id")).distinct()
    return docs.join(keep, docs[id_col].eqNullSafe(keep["_id"]), "left_semi").dropDuplicates([id_col, text_col])
