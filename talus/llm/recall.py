"""Word-level predictions for the language-model score: what followed the last two units before.

A unit is a word with the white space before it; a text's last unit is its trailing white space and its end. Two bits are
predicted for a unit before it is spelled: "it is what most often followed these two units in the training texts" and "it
is what last followed them in this text". A unit that either bit finds needs no spelling.

What followed each pair of units is counted over all texts and grows with them, so it is never held in one place. A task
cuts its texts into blocks and sends a block's distinct (context, unit) hashes to buckets that are ranges of the context
hash; a bucket adds up the counts of all blocks and answers each block, one byte a hash; answers and texts meet again by
block. A common context is sent once a block, so no key is hot. A bucket also measures how often each class of contexts is
right, every occurrence being left out of its own count.

The bits' probabilities come from two predictors, the class of the context and the outcomes of the last three bits of the
same kind, mixed in the logistic domain by weights that the last two outcomes select. Weights and outcome predictors adapt
online along the text, from the same start in each segment of SEGMENT bits, and many texts are worked on side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

#: Bits of a hashed context and of a hashed unit; bytes of text in a block and a bucket; bits that share a start.
KEY_BITS, WORD_BITS, BLOCK, BUCKET, SEGMENT = 40, 16, 4_000_000, 16_000_000, 4096
#: Classes of contexts: by the leader's share of the occurrences and by their number.
SHARES = np.array([0.25, 0.5, 0.75, 0.9, 0.9999])
AMOUNTS = 6
CLASSES = (len(SHARES) + 1) * AMOUNTS
#: The start of the mixer: weights of class, outcomes and bias; step size; prior of the outcome predictors.
START, RATE, PRIOR = np.array([0.7, 0.4, 0.0]), 0.02, 4.0
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def units(part: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each unit starts in the texts and their ends laid side by side, its hash, and each text's number of units."""
    raw = np.frombuffer(b"\0".join(part) + b"\0", dtype=np.uint8)
    size = np.fromiter(map(len, part), dtype=np.int64, count=len(part)) + 1
    end = np.cumsum(size) - 1
    space = _SPACE[raw]
    space[end] = True
    last = np.zeros(len(raw), dtype=bool)
    last[:-1] = ~space[:-1] & space[1:]
    last[end] = True
    stop = np.flatnonzero(last)
    first = np.concatenate([[0], stop[:-1] + 1])
    length = stop - first + 1
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(length.max(), _ODD))
        place = np.arange(len(raw)) - np.repeat(first, length)
        hashed = _mix(np.add.reduceat((raw.astype(np.uint64) + np.uint64(1)) * power[place], first))
    return first, hashed, np.diff(np.searchsorted(stop, end, side="right"), prepend=0)


def contexts(hashed: np.ndarray, n_units: np.ndarray) -> np.ndarray:
    """KEY_BITS of each unit's context, the two units before it in its text, then WORD_BITS of the unit."""
    first = np.cumsum(n_units) - n_units
    one = np.concatenate([[np.uint64(1)], hashed[:-1]])
    one[first] = 1
    two = np.concatenate([[np.uint64(1)], one[:-1]])
    two[first] = 1
    with np.errstate(over="ignore"):
        key = _mix(one * np.uint64(3) ^ _mix(two))
    return key >> np.uint64(64 - KEY_BITS) << np.uint64(WORD_BITS) | hashed >> np.uint64(64 - WORD_BITS)


def blocks(batches: Iterator[pa.RecordBatch], chunks, chunk: int) -> Iterator[tuple[int, pa.RecordBatch, int, list[bytes], bool]]:
    """(block, batch, offset, texts, whether the block ends) of consecutive texts. A block ends after the text that brings
    it to BLOCK bytes, whatever the batches, so two passes over the same rows cut the same blocks. The last block ends
    with an empty piece."""
    task, seq, total, open_, batch = TaskContext.get().partitionId() << 32, 0, 0, False, None
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(size):
            run = np.cumsum(size[at:])
            cut = int(np.searchsorted(run, BLOCK - total)) + 1
            piece, over = batch.slice(at, cut), cut <= len(run)
            pieces = list(_offsets(piece, chunks, chunk))
            for k, (first, part) in enumerate(pieces):
                yield task | seq, piece, first, part, over and k + 1 == len(pieces)
            total, open_ = (0, False) if over else (total + int(run[-1]), True)
            seq += over
            at += cut
    if open_:
        yield task | seq, batch, 0, [], True


def _offsets(piece: pa.RecordBatch, chunks, chunk: int) -> Iterator[tuple[int, list[bytes]]]:
    return chunks(piece.column(0), chunk)


def pack(a: np.ndarray) -> bytes:
    """Sorted numbers as steps, byte plane by byte plane."""
    step = np.diff(a, prepend=a.dtype.type(0))
    return pa.compress(step.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def unpack(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, n * 8, codec="zstd"), dtype=np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(n), dtype=np.uint64)


def slices(a: np.ndarray, cut: np.ndarray) -> pa.Array:
    """The bytes of a[cut[i]:cut[i + 1]] as an array of binaries."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer((cut * a.dtype.itemsize).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(a))]).cast(pa.binary())


ASKED = "bucket int, block long, n int, entries binary, counts binary"


def ask(chunks, chunk: int, buckets: int):
    """Arrow function over (text, held_out): the distinct entries of each block, with their training counts, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = []
        for block, piece, first, part, over in blocks(batches, chunks, chunk):
            if part:
                _, hashed, n_units = units(part)
                held = np.asarray(piece.column(1).slice(first, len(part)).to_pylist(), dtype=bool)
                kept.append(contexts(hashed, n_units) << np.uint64(1) | np.repeat(~held, n_units).astype(np.uint64))
            if over:
                both = np.sort(np.concatenate(kept))
                kept = []
                new = _starts(both >> np.uint64(1))
                n = np.add.reduceat(both & np.uint64(1), new).astype(np.uint32)
                entry = both[new] >> np.uint64(1)
                bucket = _bucket(entry, buckets)
                cut = np.append(_starts(bucket), len(entry))
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[cut[:-1]].astype(np.int32)), "block": pa.array(np.full(len(cut) - 1, block)), "n": pa.array(np.diff(cut).astype(np.int32)), "entries": pa.array([pack(entry[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], type=pa.binary()), "counts": pa.array([pa.compress(n[a:b].tobytes(), codec="zstd", asbytes=True) for a, b in zip(cut[:-1], cut[1:], strict=True)], type=pa.binary())})

    return run


def _starts(a: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, a[1:] != a[:-1]))


def _bucket(entry: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of the context hash, so that entries in order are in the order of their buckets."""
    return ((entry >> np.uint64(KEY_BITS + WORD_BITS - 32)) * np.uint64(buckets)) >> np.uint64(32)


def classes(leader: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Class of contexts by their leader's count and by the count of all that followed them; at least one did."""
    amount = np.minimum(AMOUNTS - 1, np.log2(total).astype(np.int64))
    return np.searchsorted(SHARES, leader / total) * AMOUNTS + amount


ANSWERED = "block long, bucket int, answer binary, class int, tries long, hits long"


def answer(table: pa.Table) -> pa.Table:
    """One bucket: an answer to each block (a byte an entry: 0 nothing followed the context in training, else 1 + twice the
    class, plus 1 if the unit is the leader, the most frequent one, ties by hash), and what each class got right."""
    n_of = table.column("n").to_numpy()
    entry = np.concatenate([unpack(x, n) for x, n in zip(table.column("entries").to_pylist(), n_of, strict=True)])
    count = np.concatenate([np.frombuffer(pa.decompress(x, int(n) * 4, codec="zstd"), dtype=np.uint32) for x, n in zip(table.column("counts").to_pylist(), n_of, strict=True)])
    order = np.argsort(entry, kind="stable")
    entry, count = entry[order], count[order].astype(np.int64)
    new = _starts(entry)
    own = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(entry))))
    times, key = np.add.reduceat(count, new), entry[new] >> np.uint64(WORD_BITS)
    start = _starts(key)
    of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key))))
    total, most = np.add.reduceat(times, start), np.maximum.reduceat(times, start)
    best = np.flatnonzero(times == most[of])
    best = best[_starts(of[best])]
    leads = np.zeros(len(times), dtype=bool)
    leads[best] = True
    second = np.maximum.reduceat(np.where(leads, 0, times), start)
    known = total > 0
    kind = np.zeros(len(total), dtype=np.int64)
    kind[known] = classes(most[known], total[known])
    byte = np.where(known[of], 1 + 2 * kind[of] + leads, 0).astype(np.uint8)
    back = np.empty(len(entry), dtype=np.uint8)
    back[order] = byte[own]
    cut = np.concatenate([[0], np.cumsum(n_of)])
    answers = [back[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
    # Each occurrence left out of its own count: the leader's, which may lose the lead by it, and all others'.
    tries, hits = np.zeros(CLASSES, dtype=np.int64), np.zeros(CLASSES, dtype=np.int64)
    some = total > 1
    m, s, t = most[some], second[some], total[some]
    still = m - 1 >= np.maximum(s, 1)
    lead = classes(np.where(still, m - 1, s), t - 1)
    np.add.at(tries, lead, m)
    np.add.at(hits, lead[still], m[still])
    np.add.at(tries, classes(m, t - 1)[m < t], (t - m)[m < t])
    seen = np.flatnonzero(tries)
    rows, more = len(n_of), len(seen)
    bucket = table.column("bucket").to_numpy()
    return pa.table({
        "block": pa.array([*table.column("block").to_pylist(), *[None] * more], type=pa.int64()), "bucket": pa.array(np.append(bucket, np.full(more, bucket[0])).astype(np.int32)), "answer": pa.array([*answers, *[None] * more], type=pa.binary()),
        "class": pa.array([*[None] * rows, *seen.tolist()], type=pa.int32()), "tries": pa.array([*[None] * rows, *tries[seen].tolist()], type=pa.int64()), "hits": pa.array([*[None] * rows, *hits[seen].tolist()], type=pa.int64()),
    })


def repeats(entry: np.ndarray, n_units: np.ndarray) -> np.ndarray:
    """0 if a unit's context is new in its text, 1 if another unit followed it the last time, 2 if this one did."""
    n = len(entry)
    bits = np.uint64(max(1, n.bit_length()))
    key = entry >> np.uint64(WORD_BITS)
    # Context, then place: contexts lose bits only in a block of more than 2^24 units.
    both = np.sort(key >> np.uint64(max(0, KEY_BITS + int(bits) - 64)) << bits | np.arange(n, dtype=np.uint64))
    at = (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    text = np.repeat(np.arange(len(n_units)), n_units)
    before, after = at[:-1], at[1:]
    same = (key[before] == key[after]) & (text[before] == text[after])
    out = np.zeros(n, dtype=np.uint8)
    out[after[same]] = 1 + (entry[before[same]] == entry[after[same]])
    return out


def starts(tries: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Stretched probability that each class is right; one more class for repeats within the text."""
    p = np.append((hits + 0.4) / (tries + 0.8), 0.5)
    return np.log(p / (1 - p))


def score(corpus: np.ndarray, within: np.ndarray, spelled: np.ndarray, n_units: np.ndarray, start: np.ndarray) -> np.ndarray:
    """log10 probability of each text. corpus: an answer for each unit; within: repeats(); spelled: log10 probabilities."""
    first = np.concatenate([[0], np.cumsum(n_units)[:-1]])
    asked, hit = corpus > 0, (corpus & 1 == 0) & (corpus > 0)
    second = (within > 0) & ~hit
    found = hit | (second & (within == 2))
    out = np.add.reduceat(np.where(found, 0.0, spelled), first)
    # The bits in order: a unit's corpus bit stands before its repeat bit.
    unit = np.concatenate([np.flatnonzero(asked), np.flatnonzero(second)])
    kind = np.concatenate([np.zeros(asked.sum(), dtype=np.int64), np.ones(second.sum(), dtype=np.int64)])
    order = np.argsort(unit * 2 + kind)
    unit, kind = unit[order], kind[order]
    if not len(unit):
        return out
    bit = np.where(kind == 0, hit[unit], within[unit] == 2)
    known = start[np.where(kind == 0, (corpus[unit].astype(np.int64) - 1) >> 1, CLASSES)]
    text = np.repeat(np.arange(len(n_units)), n_units)[unit]
    size = np.bincount(text, minlength=len(n_units))
    place = np.arange(len(unit)) - np.repeat(np.cumsum(size) - size, size)
    lane_first = np.flatnonzero(place % SEGMENT == 0)
    lane_size = np.diff(np.append(lane_first, len(unit)))
    longest = np.argsort(-lane_size, kind="stable")
    lane_first, lane_size = lane_first[longest], lane_size[longest]
    lost = _adaptive(lane_first, lane_size, kind, bit.astype(float), known)
    np.add.at(out, text[lane_first], lost)
    return out


def _adaptive(first: np.ndarray, size: np.ndarray, kind: np.ndarray, bit: np.ndarray, known: np.ndarray) -> np.ndarray:
    """log10 probability of each lane's bits, lanes by size from the longest; all step together."""
    n = len(first)
    weight = np.tile(START, (n * 8, 1))
    seen, ones = np.full(n * 16, 2 * PRIOR), np.full(n * 16, PRIOR)
    past, out = np.zeros(n * 2, dtype=np.int64), np.zeros(n)
    active = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
    lanes = np.arange(n)
    x = np.ones((n, 3))
    for step in range(size[0]):
        m = active[step]
        at = first[:m] + step
        lane = lanes[:m] * 2 + kind[at]
        y, recent = bit[at], past[lane]
        state, gate = lane * 8 + recent, lane * 4 + (recent & 3)
        q = ones[state] / seen[state]
        z = x[:m]
        z[:, 0], z[:, 1] = known[at], np.log(q / (1 - q))
        w = weight[gate]
        p = 1 / (1 + np.exp(-np.clip(np.einsum("ij,ij->i", z, w), -12, 12)))
        out[:m] += np.log10(np.where(y == 1, p, 1 - p))
        weight[gate] = w + (RATE * (y - p))[:, None] * z
        ones[state] += y
        seen[state] += 1
        past[lane] = (recent * 2 + y.astype(np.int64)) & 7
    return out
