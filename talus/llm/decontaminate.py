"""Benchmark decontamination by the CGK embedding and bit-sampling LSH.

The CGK random walk writes, at step j, the word at its position and then moves on by a random bit that depends on j and
the word. Texts of small edit distance give outputs of small Hamming distance, since the walks fall into step again behind
an edit. A repeat samples outputs of a walk of its own; two windows collide if these agree. Walks start at every word of a
document, each the start of an item-sized window, and, for the items, at anchors every word or two, so that every stretch
between two edits can give an item away. The shorter an item, the shorter its walks (TIERS). Each collision proposes a
window of the item's size, which is verified by the exact edit distance in words (banded, over all proposals of a batch at
once).

The walk is a gather and an add for each word and step in numpy; signatures are looked up in a bit table, then in a sorted
array. Items are taken in blocks of BLOCK, each broadcast by itself, so what is broadcast has a fixed bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import byte_chunks, released
from .shingles import mix, words

#: Edits a word of the item that still count as a leak; shortest item that is walked (shorter ones allow no edit).
EDITS, SHORTEST = 0.2, 5
#: Words of an item from which the tier holds, repeats, steps of a walk, outputs sampled of it, words from anchor to anchor.
#: Set by measured recall at one edit in ten and in five words; a test holds it for every length.
TIERS = ((30, 8, 28, 4, 2), (15, 10, 14, 4, 1), (10, 8, 8, 3, 1), (SHORTEST, 6, 4, 2, 1))
STEPS = max(x[2] for x in TIERS)
BLOCK, CHUNK = 4096, 1_000_000
#: Proposals that are gathered before they are verified.
PROPOSALS = 500_000
_TABLE = 20


def _samples(n: int, steps: int, sampled: int) -> list[tuple[int, tuple[int, ...]]]:
    """(walk, steps) of each repeat, which has a walk of its own; one step out of each of as many equal stretches."""
    r = np.random.default_rng(steps)
    cuts = np.linspace(0, steps, sampled + 1).astype(int)
    return [(i, tuple(int(r.integers(a, b)) for a, b in zip(cuts, cuts[1:], strict=False))) for i in range(n)]


def walk(hashed: np.ndarray, start: np.ndarray, samples: list) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """For each repeat, a signature of each start and the first and last position that it read.

    hashed must go on for the steps of a walk.
    """
    sig, first, last = [], [], []
    for w, steps in samples:
        bits = mix(hashed ^ np.uint64(0xA5A5A5A5 + w))
        at, s = start.copy(), np.zeros(len(start), dtype=np.uint64)
        for j in range(steps[-1] + 1):
            if j in steps:
                s = (s + hashed[at]) * np.uint64(0x9E3779B97F4A7C15)
                if j == steps[0]:
                    first.append(at.copy())
            at += ((bits[at] >> np.uint64(j)) & np.uint64(1)).astype(np.int64) if j < steps[-1] else 0
        sig.append(mix(s))
        last.append(at)
    return sig, first, last


def _windows(hashed: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k words that follow each other."""
    out = np.zeros(max(0, len(hashed) - k + 1), dtype=np.uint64)
    for j in range(k):
        out = (out + hashed[j : j + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
    return mix(out)


def _matches(sig: np.ndarray, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place in sig, place in the sorted keys) of all that are equal, about PROPOSALS at a time."""
    a, b = np.searchsorted(keys, sig), np.searchsorted(keys, sig, side="right")
    at = np.flatnonzero(b > a)
    a, k = a[at], (b - a)[at]
    total = np.cumsum(k)
    first = 0
    while first < len(at):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + PROPOSALS, side="right")))
        n = k[first:last]
        entry = np.repeat(a[first:last] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        yield np.repeat(at[first:last], n), entry
        first = last


class Index:
    """Signatures of a block of items."""

    def __init__(self, ids: list, items: list[str]):
        hashed, _, _, of = words([x.encode().lower() for x in items]) if items else (np.zeros(0, dtype=np.uint64),) * 4
        n = np.bincount(of.astype(np.int64), minlength=len(items))
        first = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(items) else n
        self.ids, self.words = ids, [hashed[a : a + k] for a, k in zip(first, n, strict=True)]
        padded = np.concatenate([hashed, np.zeros(STEPS + 1, dtype=np.uint64)])
        self.tiers = []
        most = None
        for least, n_repeats, steps, sampled, every in TIERS:
            own = [(i, a) for i, k in enumerate(n) if k >= least and (most is None or k < most) for a in range(0, int(k), every)]
            most = least
            if not own:
                continue
            samples = _samples(n_repeats, steps, sampled)
            item, anchor = (np.array(x, dtype=np.int64) for x in zip(*own, strict=True))
            sigs, begin, last = walk(padded, first[item] + anchor, samples)
            tables = []
            for s, a, end in zip(sigs, begin, last, strict=True):
                # A signature of a single word would collide wherever that word is.
                inside = (end < first[item] + n[item]) & (end > a)
                order = np.argsort(s[inside], kind="stable")
                bits = np.zeros(1 << _TABLE, dtype=bool)
                bits[(s[inside] >> np.uint64(64 - _TABLE)).astype(np.int64)] = True
                tables.append((np.packbits(bits), s[inside][order], item[inside][order].astype(np.int32), anchor[inside][order].astype(np.int32)))
            self.tiers.append((samples, tables))
        # Items too short for a walk allow no edit: their whole hash is looked up instead.
        self.short = {}
        for k in range(1, SHORTEST):
            own = np.flatnonzero(n == k)
            if len(own):
                keys = _windows(np.concatenate([self.words[i] for i in own]), k)[:: k]
                order = np.argsort(keys, kind="stable")
                self.short[k] = keys[order], own[order].astype(np.int32)

    def scan(self, part: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(text, item, first word, edits) of each item found in each text, at its best window."""
        hashed, _, _, of = words(part)
        n = len(hashed)
        if not n:
            return []
        padded = np.concatenate([hashed, np.zeros(STEPS + 1, dtype=np.uint64)])
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for k, (keys, item) in self.short.items():
            for at, entry in _matches(_windows(padded[: n + k - 1], k), keys) if n >= k else ():
                inside = (at + k <= n) & (of[np.minimum(at + k - 1, n - 1)] == of[at])
                at, entry = at[inside], entry[inside]
                same = np.array([np.array_equal(hashed[x : x + k], self.words[i]) for x, i in zip(at, item[entry], strict=True)], dtype=bool)
                for x, i in zip(at[same].tolist(), item[entry[same]].tolist(), strict=True):
                    best.setdefault((int(of[x]), i), (0, int(x - np.searchsorted(of, of[x]))))
        for samples, tables in self.tiers:
            sigs, _, _ = walk(padded, np.arange(n), samples)
            proposals: list[np.ndarray] = []
            for s, (bits, keys, item, anchor) in zip(sigs, tables, strict=True):
                maybe = np.flatnonzero(np.unpackbits(bits).view(bool)[(s >> np.uint64(64 - _TABLE)).astype(np.int64)])
                for at, entry in _matches(s[maybe], keys):
                    at = maybe[at]
                    # One proposal for each item and start; starts that differ by an edit or two come out of the same band.
                    proposals.append(np.unique(np.stack([of[at].astype(np.int64), item[entry], at - anchor[entry]], axis=1), axis=0))
                    if sum(map(len, proposals)) > PROPOSALS:
                        self._verify(best, hashed, of, np.unique(np.concatenate(proposals), axis=0))
                        proposals = []
            if proposals:
                self._verify(best, hashed, of, np.unique(np.concatenate(proposals), axis=0))
        return [(text, item, s, e) for (text, item), (e, s) in sorted(best.items())]

    def _verify(self, best: dict[tuple[int, int], tuple[int, int]], hashed: np.ndarray, of: np.ndarray, proposals: np.ndarray) -> None:
        """Take the proposals within the allowed edits into best, which holds (edits, start) by text and item."""
        size = np.array([len(x) for x in self.words])
        for n in np.unique(size[proposals[:, 1]]):
            own = proposals[size[proposals[:, 1]] == n]
            for a in range(0, len(own), 20_000):
                rows = own[a : a + 20_000]
                edits, start = self._distance(hashed, of, rows, int(n))
                ok = edits <= math.floor(EDITS * n)
                for (text, item, _), e, s in zip(rows[ok].tolist(), edits[ok].tolist(), start[ok].tolist(), strict=True):
                    best[text, item] = min(best.get((text, item), (e, s)), (e, s))

    def _distance(self, hashed: np.ndarray, of: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Least edit distance between the item and a window that starts at the proposal, give or take the allowed edits.

        Cell d of a row holds the best (edits, start) of an alignment that ends at word start + i + d, as one number.
        """
        band = math.floor(EDITS * n)
        d = np.arange(-band, band + 1)
        item = np.stack([self.words[i] for i in rows[:, 1]])
        # Only words of the text itself count; where the window leaves it, nothing matches.
        at = rows[:, 2][:, None] + np.arange(-band, n + band)
        inside = (at >= 0) & (at < len(hashed))
        at = np.clip(at, 0, len(hashed) - 1)
        inside &= of[at] == rows[:, 0][:, None]
        window = hashed[at]
        unit = np.int64(2 * band + 2)
        # The number is edits * unit + start offset, so that the least one has the fewest edits, then the first start.
        cell = np.tile((d + band).astype(np.int64), (len(rows), 1))
        for i in range(n):
            other = (window[:, i : i + 2 * band + 1] != item[:, i : i + 1]) | ~inside[:, i : i + 2 * band + 1]
            new = cell + other * unit
            new[:, :-1] = np.minimum(new[:, :-1], cell[:, 1:] + unit)
            cell = np.minimum.accumulate(new - d * unit, axis=1) + d * unit
        least = cell.min(1)
        first = rows[:, 2] + least % unit - band
        return least // unit, first - np.searchsorted(of, rows[:, 0])


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Index]:
    rows = items.select(id_col, text_col).where(F.col(text_col).isNotNull()).toLocalIterator()
    while block := list(islice(rows, BLOCK)):
        yield Index([r[0] for r in block], [r[1] for r in block])


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id, item id, first_word, n_words and edits of every item that a text holds within EDITS edits a word.

    A row for each document row and item, at the window of fewest edits, then the first. Words are runs of anything but
    ASCII white space, A-Z in lower case. Items of fewer than SHORTEST words allow no edit and are found by a hash of all
    their words. Items without words, null ones included, are never found, nor is anything in a null or empty text. Texts
    are read whole, whatever their length. Repeated documents or items give repeated rows. Other columns are ignored. No
    document or no item: no row.
    """
    spark = docs.sparkSession
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, {item_col} {items.schema[item_col].dataType.simpleString()}, first_word long, n_words long, edits long"
    item_type = to_arrow_type(items.schema[item_col].dataType)
    out = spark.createDataFrame([], schema)
    for index in _blocks(items, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(index)

        @released
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, part in byte_chunks(batch.column(1), CHUNK):
                    if hits := shared.value.scan(part):
                        text, item, start, edits = zip(*hits, strict=True)
                        columns = [batch.column(0).take(pa.array([first + t for t in text])), pa.array([shared.value.ids[i] for i in item], type=item_type), pa.array(start, type=pa.int64()), pa.array([len(shared.value.words[i]) for i in item], type=pa.int64()), pa.array(edits, type=pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, names=[id_col, item_col, "first_word", "n_words", "edits"])

        out = out.unionByName(docs.select(id_col, text_col).mapInArrow(run, schema))
    return out


def remove(docs: DataFrame, items: DataFrame, text_col: str = "text", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, with its columns, whose text holds no item by the rule of find().

    Null and empty texts hold none and stay, as do all rows if there are no items; of repeated rows all stay or all go.
    Other columns are handed through, whatever their names.
    """
    spark, at = docs.sparkSession, docs.columns.index(text_col)
    for index in _blocks(items.select(F.lit(0).alias("_id"), item_text_col), "_id", item_text_col):
        shared = spark.sparkContext.broadcast(index)

        @released
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for first, part in byte_chunks(batch.column(at), CHUNK):
                    keep[[first + hit[0] for hit in shared.value.scan(part)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
