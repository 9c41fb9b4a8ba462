"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

The byte positions of a piece are the leaves of a segment tree. A leaf holds the rank of the pair that starts at its
position (the part there and the next live part), or NONE. An inner node holds the least (rank, position) below it, so
the root names the leftmost pair of least rank. A merge changes three leaves at most (the merged part, the part it
swallowed and the live left neighbour), each by a walk to the root: O(log n) a merge, O(n log n) a piece, where the
usual rescan of all parts is O(n^2).

Pieces of up to LANES bytes run side by side in numpy, one tree a row; a longer piece has a tree of its own. Encoded
pieces are remembered in a table of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import released, text_chunks

#: Bytes of the longest piece that is encoded in a numpy lane.
LANES = 64
#: Pieces that a worker remembers; the table is emptied beyond this.
REMEMBERED = 400_000
#: Characters handled at a time, and characters of the longest piece that is remembered.
CHUNK, REMEMBERED_CHARS = 1_000_000, 64
NONE = np.iinfo(np.int64).max


class ByteBPE:
    """Encoder and decoder for a table of ranks (bytes -> id) and a splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        # \s is Unicode's White_Space here, as in the tokenizer's own pattern engine.
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.bytes_of = dict(zip(ranks.values(), ranks, strict=True))
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        left, right, out = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), out.append(rank)
        keys = np.array(left, dtype=np.int64) << 32 | np.array(right, dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array(out, dtype=np.int64)[order]
        self.pairs = dict(zip(keys.tolist(), out, strict=True))
        self.known: dict[str, bytes] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def _pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)

    def _lanes(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Encode pieces of width bytes at most, a power of two, one segment tree a row."""
        m, pos = len(pieces), np.arange(width)
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=m)
        raw = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), dtype=np.uint8).reshape(m, width)
        part = self.byte_ids[raw]
        live = pos < size[:, None]
        right = np.where(pos + 1 < size[:, None], pos + 1, width)[:, :]
        left = np.tile(pos - 1, (m, 1))
        tree = np.full((m, 2 * width), NONE)
        rank = self._pair_rank(part[:, :-1].ravel(), part[:, 1:].ravel()).reshape(m, width - 1)
        paired = (pos[:-1] + 1 < size[:, None]) & (rank != NONE)
        tree[:, width : 2 * width - 1] = np.where(paired, rank * width + pos[:-1], NONE)
        for level in range(width.bit_length() - 2, -1, -1):
            n = 1 << level
            tree[:, n : 2 * n] = np.minimum(tree[:, 2 * n : 4 * n : 2], tree[:, 2 * n + 1 : 4 * n : 2])
        rows = np.flatnonzero(tree[:, 1] != NONE)
        while len(rows):
            best = tree[rows, 1]
            at, rank = best % width, best // width
            gone = right[rows, at]
            after, before = right[rows, gone], left[rows, at]
            part[rows, at] = rank
            live[rows, gone] = False
            right[rows, at] = after
            some = after < width
            left[rows[some], after[some]] = at[some]
            leaf = np.full(len(rows), NONE)
            found = self._pair_rank(rank[some], part[rows[some], after[some]])
            leaf[some] = np.where(found != NONE, found * width + at[some], NONE)
            self._set(tree, rows, at + width, leaf)
            self._set(tree, rows, gone + width, np.full(len(rows), NONE))
            some = before >= 0
            found = self._pair_rank(part[rows[some], before[some]], rank[some])
            self._set(tree, rows[some], before[some] + width, np.where(found != NONE, found * width + before[some], NONE))
            rows = rows[tree[rows, 1] != NONE]
        ids, ends = part[live].astype("<u4").tobytes(), (4 * np.cumsum(live.sum(1))).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    @staticmethod
    def _set(tree: np.ndarray, rows: np.ndarray, node: np.ndarray, value: np.ndarray) -> None:
        """Point update of one leaf a row, then of its ancestors."""
        tree[rows, node] = value
        while len(node) and node[0] > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def _long(self, piece: bytes) -> bytes:
        """Encode one piece of any length; the same tree in lists."""
        n, pairs = len(piece), self.pairs
        width = 1 << max(1, (n - 1).bit_length())
        part = [int(self.byte_ids[b]) for b in piece]
        left, right, none = list(range(-1, n - 1)), list(range(1, n + 1)), (1 << 62)
        tree = [none] * (2 * width)
        for i in range(n - 1):
            if (rank := pairs.get(part[i] << 32 | part[i + 1])) is not None:
                tree[width + i] = rank * width + i
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i: int, rank: int | None) -> None:
            node = width + i
            tree[node] = none if rank is None else rank * width + i
            while node > 1:
                node >>= 1
                new = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == new:
                    return
                tree[node] = new

        while tree[1] < none:
            rank, i = divmod(tree[1], width)
            j = right[i]
            k, h = right[j], left[i]
            part[i], part[j], right[i] = rank, -1, k
            if k < n:
                left[k] = i
            put(i, pairs.get(rank << 32 | part[k]) if k < n else None)
            put(j, None)
            if h >= 0:
                put(h, pairs.get(part[h] << 32 | rank))
        return np.array([x for x in part if x >= 0], dtype="<u4").tobytes()

    def _encode_new(self, pieces: list[str]) -> dict[str, bytes]:
        out, lanes = {}, {}
        for x in pieces:
            raw = x.encode()
            if (rank := self.ranks.get(raw)) is not None:
                out[x] = rank.to_bytes(4, "little")
            elif len(raw) > LANES:
                out[x] = self._long(raw)
            else:
                lanes.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((x, raw))
        for width, rows in lanes.items():
            step = (1 << 19) // width
            for a in range(0, len(rows), step):
                part = rows[a : a + step]
                out.update(zip((x for x, _ in part), self._lanes([raw for _, raw in part], width), strict=True))
        return out

    def encode(self, items: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.split.findall(x) for x in items]
        new = set().union(*split) - self.known.keys() if split else set()
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = set().union(*split)
        fresh = self._encode_new(list(new))
        at = self.known if len(fresh) <= REMEMBERED else {}
        at.update(fresh)
        out = [b"".join(map(at.__getitem__, x)) for x in split]
        for x in fresh:
            if len(x) > REMEMBERED_CHARS:
                at.pop(x)
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> ByteBPE:
    return ByteBPE.from_file(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and decode the ids again: id, tokens array<int>, decoded binary.

    A row for each row, repeated ids included. A null text counts as empty and has no tokens; so has an empty one.
    Texts of any length are encoded whole. Other columns are ignored, whatever their names.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path, pattern)
        for batch in batches:
            for first, part in text_chunks(batch.column(1), CHUNK):
                ids = enc.encode(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), _lists(ids), pa.array([enc.decode(x) for x in ids], type=pa.binary())], names=[id_col, "tokens", "decoded"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, tokens array<int>, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_tokens: bool = False) -> DataFrame:
    """encode() reduced to id, n_tokens, ids_sha256 and decoded_sha256 before the rows leave the worker.

    with_tokens adds tokens array<int>, the ids themselves. Rows are treated as by encode().
    """
    kind = docs.schema[id_col].dataType.simpleString()

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for first, part in text_chunks(batch.column(1), CHUNK):
                ids = enc.encode(part)
                columns = [batch.column(0).slice(first, len(part)), pa.array([len(x) // 4 for x in ids], type=pa.int64()), pa.array([sha(x) for x in ids]), pa.array([sha(enc.decode(x)) for x in ids])]
                yield pa.RecordBatch.from_arrays(columns + [_lists(ids)] * with_tokens, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["tokens"] * with_tokens)

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", tokens array<int>" * with_tokens)


def _lists(ids: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))
