"""Hashes of words and word shingles, for whole batches of texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(b" \t\n\v\f\r")] = True
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, dtype=np.uint64), np.full(n, inverse, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def words(part: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end and text number of each word: of each run of bytes that are not ASCII white space.

    Starts and ends are bytes from the beginning of the joined texts; each text is followed by one white space.
    """
    raw = np.frombuffer(b"\n".join(part) + b"\n", dtype=np.uint8)
    inside = np.concatenate([[False], ~_SPACE[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    bounds = np.concatenate([[0], np.cumsum([len(x) + 1 for x in part])])
    text = np.searchsorted(bounds, start, side="right") - 1
    up, down = _powers(max(1 << 20, 1 << len(raw).bit_length()))
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])
    hashed = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return hashed, start, end, text


def shingle_sets(part: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of k words of each text, as sorted 52-bit hashes one text after the other, and their counts.

    A text of 1 to k - 1 words has one shingle, of all its words; a text without words has none. At most 4096 texts.
    """
    hashed, _, _, text = words(part)
    n_words = np.bincount(text, minlength=len(part))
    first = np.concatenate([[0], np.cumsum(n_words)])
    n = len(hashed)
    h = np.zeros(n, dtype=np.uint64)
    padded = np.concatenate([hashed, np.zeros(k, dtype=np.uint64)])
    at, left = np.arange(n), first[1:][text] - np.arange(n) if n else np.zeros(0, dtype=int)
    for j in range(k):
        h = mix(h + np.where(left > j, padded[at + j], np.uint64(j + 1)) * np.uint64(2 * j + 0x9E3779B97F4A7C15))
    starts = (left >= k) | ((n_words[text] < k) & (at == first[text]))
    keys = np.unique((text[starts].astype(np.uint64) << np.uint64(52)) | (h[starts] >> np.uint64(12)))
    return keys & np.uint64((1 << 52) - 1), np.bincount((keys >> np.uint64(52)).astype(np.int64), minlength=len(part))
