"""Language-model scores by logistic context mixing over bits, beside a smoothed unigram score.

The text (A-Z in lower case, one zero byte as its end) is a sequence of units, words with the white space before them.
Up to two bits ask whether a unit is one that its context recalls (recall.py: the corpus' and the text's own memory of the
two units before); only what they do not find is spelled, bit by bit. For each of four contexts (the last one to four
bytes, hashed into a fixed number of slots) a predictor holds how often a one followed at each node of the byte's bit tree.
The predictions, stretched to the logistic domain, are combined by weights that a gate selects (how much the longer
contexts have seen, and the bit's depth). These weights are trained online: each step mends the error of the prediction
just made, in which an example's own count is left out. An adaptive probability map then refines the mix by bit node and
interpolated prediction. The text's log-probability is the sum over its bits.

Spark counts the byte grams of all training texts. Every distinct gram trains the weights: each partition of about
PARTITION grams trains its own from the same start, and the weights are averaged by what each gate has seen there. What
the units' contexts recall grows with the corpus and is never in one place; the byte predictors have a fixed size. The
weights of the units' bits adapt along each text from a fixed start, so a row that is computed again after an executor is
lost scores the same, and no score depends on other texts' order.

The unigram score needs the counts of all training words. The HEAD most frequent words are broadcast; a text's other words,
few by Zipf's law, are joined with the full counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import recall
from .common import byte_chunks, stage

#: Slots of the hashed contexts of one to four bytes (powers of two).
SLOTS = (1 << 8, 1 << 13, 1 << 14, 1 << 15)
#: Words whose counts are broadcast; grams of a partition that trains; passes; step size; prior of a predictor.
HEAD, PARTITION, PASSES, RATE, PRIOR = 1 << 17, 1 << 18, 3, 0.02, 0.3
#: Steps of the probability map between stretched predictions of -8 and 8.
MAP_STEPS = 32
#: Bytes handled at a time; entries that a worker gathers before it hands them on, and gram scores that it remembers.
CHUNK, GATHERED, REMEMBERED = 1_000_000, 400_000, 1 << 20
#: A unit's spelling is handed on in half precision up to this many decimal digits; what exceeds it is always charged.
LONGEST = 1e6


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, mod 5, is 1. A null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def _slots(gram):
    """Slots of the contexts of a packed gram (four context bytes, then the byte); the same for arrays and Columns."""
    array = isinstance(gram, np.ndarray)
    right = (lambda x, k: x >> k) if array else F.shiftright
    low = (lambda x, n: x & (n - 1)) if array else (lambda x, n: x.bitwiseAND(n - 1))
    context = right(gram, 8)
    out = [low(context, 256)]
    for k, n in enumerate(SLOTS[1:], 2):
        own = low(context, 1 << (8 * k))
        out.append(low(right(own * 1000003 + right(own, 11) * 7919, 6), n))
    return tuple(out)


def byte_grams(part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Packed grams of five bytes, one for each byte of each text and its end, and where each text's grams start."""
    order = len(SLOTS)
    sizes = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
    raw = np.frombuffer(b"".join(b"\0" * order + x + b"\0" for x in part), dtype=np.uint8)
    packed = np.zeros(len(raw) - order, dtype=np.int64)
    for k in range(order + 1):
        packed <<= 8
        packed |= raw[k : len(raw) - order + k]
    first = np.concatenate([[0], np.cumsum(sizes + order + 1)])
    keep = np.ones(len(raw), dtype=bool)
    for k in range(1, order + 1):
        keep[first[1:] - k] = False  # these grams would reach into the next text
    return packed[keep[: len(packed)]], first[:-1] - order * np.arange(len(part))


def count(train: DataFrame, text_col: str) -> DataFrame:
    """Counts of the training texts' words (word, n) and byte grams (gram, n), in one table.

    A worker adds up its own counts and hands them on when it has gathered many, so its memory is bounded. The row with
    gram -1 counts the texts.
    """

    def out(words: Counter, grams: dict[str, np.ndarray], n_texts: int) -> Iterator[pa.RecordBatch]:
        kept = np.append(grams["key"], -1), np.append(grams["n"], n_texts)
        n = len(words)
        word = pa.concat_arrays([pa.array(list(words), type=pa.binary()), pa.nulls(len(kept[0]), pa.binary())])
        gram = pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(kept[0])])
        yield pa.RecordBatch.from_arrays([word, gram, pa.concat_arrays([pa.array(list(words.values()), type=pa.int64()), pa.array(kept[1])])], names=["word", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = {"key": np.zeros(0, dtype=np.int64), "n": np.zeros(0, dtype=np.int64)}
        words, grams, n_texts = Counter(), dict(none), 0
        for batch in batches:
            for _, part in byte_chunks(batch.column(0), CHUNK):
                n_texts += len(part)
                for x in part:
                    words.update(x.split())
                key, n = np.unique(byte_grams(part)[0], return_counts=True)
                key, n = np.concatenate([grams["key"], key]), np.concatenate([grams["n"], n])
                order = np.argsort(key, kind="stable")
                key, n = key[order], n[order]
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                grams = {"key": key[first], "n": np.add.reduceat(n, first)}
                if len(words) + len(grams["key"]) > 2 * GATHERED:
                    yield from out(words, grams, n_texts)
                    words, grams, n_texts = Counter(), dict(none), 0
        yield from out(words, grams, n_texts)

    return train.select(text_col).mapInArrow(run, "word binary, gram long, n long").groupBy("word", "gram").agg(F.sum("n").alias("n"))


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


class Mixer:
    """Bit predictors over hashed contexts, gated weights and a probability map.

    Tables have a row for each slot and a column for each node of the bit tree. While the mixer trains it holds counts, so
    that an example's own can be left out; freeze() turns them into stretched predictions and classes of certainty.
    """

    def __init__(self, order: np.ndarray, key: np.ndarray, n: np.ndarray):
        """order and key (slot * 256 + byte) of each counted context and byte, with its count."""
        self.ones, self.zeros = [], []
        for k, slots in enumerate(SLOTS):
            own = order == k
            leaf = np.bincount(key[own], weights=n[own], minlength=slots * 256).reshape(slots, 256)
            one, zero = np.zeros((slots, 256), dtype=np.uint16), np.zeros((slots, 256), dtype=np.uint16)
            for depth in range(7, -1, -1):
                pair = leaf.reshape(slots, 1 << depth, 2)
                # Larger counts are halved together until they fit: only their ratio matters then.
                scale = np.exp2(np.maximum(0, np.frexp(pair.max(2, keepdims=True))[1] - 16))
                zero[:, 1 << depth : 2 << depth], one[:, 1 << depth : 2 << depth] = np.moveaxis(np.floor(pair / scale), 2, 0)
                leaf = pair.sum(2)
            self.ones.append(one), self.zeros.append(zero)
        inputs = len(SLOTS) + 1
        self.weights = np.tile(np.append(np.full(inputs - 1, 1 / (inputs - 1)), 0.0), (8 * 6 * 6, 1))
        self.map = np.tile(_squash(np.linspace(-8, 8, MAP_STEPS + 1)), (256, 1))
        self.frozen: list[tuple[np.ndarray, np.ndarray]] = []

    def fresh(self) -> Mixer:
        """The same predictors with weights and map of its own."""
        other = copy(self)
        other.weights, other.map = self.weights.copy(), self.map.copy()
        return other

    @staticmethod
    def _predict(one: np.ndarray, zero: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, zero = one.astype(np.float32), zero.astype(np.float32)
        return np.log((one + PRIOR) / (zero + PRIOR)), np.minimum(5, np.log2(one + zero + 1) / 2).astype(np.uint8)

    def freeze(self) -> Mixer:
        while self.ones:
            x, sure = self._predict(self.ones.pop(0), self.zeros.pop(0))
            self.frozen.append((x.astype(np.float16), sure))
        return self

    def _inputs(self, slots: tuple, node: np.ndarray, depth: int, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Stretched predictions with a bias, and the gate. own: the example's bit, to be left out of the counts."""
        x, sure = np.ones((len(node), len(SLOTS) + 1)), []
        for k, slot in enumerate(slots):
            if own is None:
                x[:, k], s = (t[slot, node] for t in self.frozen[k])
            else:
                one, zero = self.ones[k][slot, node].astype(np.int64), self.zeros[k][slot, node].astype(np.int64)
                exact = np.maximum(one, zero) < 1 << 15  # in larger pairs, perhaps halved ones, one example is nothing
                x[:, k], s = self._predict(np.maximum(one - own * exact, 0), np.maximum(zero - (1 - own) * exact, 0))
            sure.append(s.astype(np.int64))
        return x, (depth * 6 + sure[-1]) * 6 + sure[-2]

    def _mapped(self, node: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (np.clip(x, -7.999, 7.999) + 8) * MAP_STEPS / 16
        low = at.astype(np.int64)
        part = at - low
        return (1 - part) * self.map[node, low] + part * self.map[node, low + 1], low, part

    def train(self, gram: np.ndarray, n: np.ndarray, passes: int = PASSES, rate: float = RATE) -> np.ndarray:
        """Online steps over the grams, each weighted by its count, in a fixed shuffled order; what each gate has seen."""
        shuffled = np.random.default_rng(0).permutation(len(gram))
        moment, had = np.full(self.weights.shape, 1e-4), np.zeros(len(self.weights))
        for _ in range(passes):
            for a in range(0, len(gram), 2048):
                rows = shuffled[a : a + 2048]
                slots, byte, weight = _slots(gram[rows]), gram[rows] & 0xFF, n[rows].astype(float)
                node = np.ones(len(rows), dtype=np.int64)
                for depth in range(8):
                    bit = (byte >> (7 - depth)) & 1
                    x, gate = self._inputs(slots, node, depth, bit)
                    error = (bit - _squash((x * self.weights[gate]).sum(1))) * weight
                    of = np.unique(gate)
                    total = np.bincount(gate, weights=weight)[of]
                    step = np.stack([np.bincount(gate, weights=error * x[:, k])[of] for k in range(x.shape[1])], axis=1) / total[:, None]
                    moment[of] += 0.1 * (step**2 - moment[of])
                    self.weights[of] += rate * step / (np.sqrt(moment[of]) + 1e-3)
                    had[of] += total
                    node = node * 2 + bit
        return had

    def outcomes(self, gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ones and all bits at each step of the map, by bit node, each example shared by the two steps around it."""
        hits, tries = np.zeros(self.map.shape), np.zeros(self.map.shape)
        for a in range(0, len(gram), 65536):
            slots, byte, weight = _slots(gram[a : a + 65536]), gram[a : a + 65536] & 0xFF, n[a : a + 65536].astype(float)
            node = np.ones(len(byte), dtype=np.int64)
            for depth in range(8):
                bit = (byte >> (7 - depth)) & 1
                x, gate = self._inputs(slots, node, depth, bit)
                _, low, part = self._mapped(node, (x * self.weights[gate]).sum(1))
                for at, share in ((low, (1 - part) * weight), (low + 1, part * weight)):
                    np.add.at(hits, (node, at), share * bit)
                    np.add.at(tries, (node, at), share)
                node = node * 2 + bit
        return hits, tries

    def log10(self, gram: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's last byte after the others."""
        slots, byte = _slots(gram), gram & 0xFF
        node, out = np.ones(len(gram), dtype=np.int64), np.zeros(len(gram))
        for depth in range(8):
            bit = (byte >> (7 - depth)) & 1
            x, gate = self._inputs(slots, node, depth, None)
            mixed = (x * self.weights[gate]).sum(1)
            p = np.clip((_squash(mixed) + self._mapped(node, mixed)[0]) / 2, 1e-6, 1 - 1e-6)
            out += np.log10(np.where(bit == 1, p, 1 - p))
            node = node * 2 + bit
        return out


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of the highest counts n, most of them at the utmost: whole sixteenths of a doubling, from the top down.

    Counting by size class needs no sort and no task that gathers candidates from all others.
    """
    size = F.floor(F.log2(F.col("n")) * 16).cast("int")
    total, least = 0, None
    for c, k in counts.groupBy(size.alias("c")).count().orderBy(F.desc("c")).collect():
        total += k
        if total > most:
            break
        least = c
    return counts.where(size >= least) if least is not None else counts.limit(0)


def _whole(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    rows = list(batches)
    return tuple(np.concatenate([r.column(k).to_numpy() for r in rows]) if rows else np.zeros(0, dtype=np.int64) for k in range(2))


def fit(counts: DataFrame) -> Mixer:
    """Byte predictors, weights and map from all counted grams."""
    spark = counts.sparkSession
    grams = counts.where("gram >= 0").select("gram", "n")
    slots = _slots(F.col("gram"))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("o"), (s * 256 + F.col("gram").bitwiseAND(0xFF)).cast("long").alias("key")) for k, s in enumerate(slots))))
    rows = grams.select(each.alias("e"), "n").groupBy("e.o", "e.key").agg(F.sum("n").alias("n")).toArrow()
    mixer = Mixer(*(rows.column(i).to_numpy() for i in range(3)))
    dealt = grams.repartition(max(1, -(-grams.count() // PARTITION)), F.xxhash64("gram")).sortWithinPartitions("gram")
    shared = spark.sparkContext.broadcast(mixer)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, n = _whole(batches)
        if len(gram):
            own = shared.value.fresh()
            had = own.train(gram, n)
            of = np.flatnonzero(had)
            yield pa.RecordBatch.from_pydict({"gate": pa.array(of), "had": pa.array(had[of])} | {f"w{k}": pa.array(w * had[of]) for k, w in enumerate(own.weights[of].T)})

    inputs = [f"w{k}" for k in range(mixer.weights.shape[1])]
    trained = dealt.mapInArrow(train, "gate long, had double, " + ", ".join(f"{w} double" for w in inputs))
    for r in trained.groupBy("gate").agg(*(F.sum(w) / F.sum("had") for w in inputs)).collect():
        mixer.weights[r[0]] = r[1:]
    weights = mixer.weights

    def outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, n = _whole(batches)
        if len(gram):
            own = shared.value.fresh()
            own.weights = weights
            hits, tries = own.outcomes(gram, n)
            at = np.flatnonzero(tries)
            yield pa.RecordBatch.from_pydict({"at": pa.array(at), "hits": pa.array(hits.reshape(-1)[at]), "tries": pa.array(tries.reshape(-1)[at])})

    found = dealt.mapInArrow(outcomes, "at long, hits double, tries double").groupBy("at").agg(F.sum("hits"), F.sum("tries")).toArrow()
    at, hits, tries = (found.column(k).to_numpy() for k in range(3))
    flat = mixer.map.reshape(-1)
    flat[at] = (8 * flat[at] + hits) / (8 + tries)
    shared.destroy()
    return mixer.freeze()


class _Scores:
    """Gram scores of a worker, remembered in a table of REMEMBERED places; a gram has one place, the latest holds it."""

    def __init__(self, mixer: Mixer):
        self.mixer, self.keys, self.values = mixer, np.full(REMEMBERED, -1, dtype=np.int64), np.zeros(REMEMBERED)

    def of(self, packed: np.ndarray) -> np.ndarray:
        place = self._place(packed)
        out, new = self.values[place], self.keys[place] != packed
        if new.any():
            own = np.unique(packed[new])
            scores = self.mixer.log10(own)
            out[new] = scores[np.searchsorted(own, packed[new])]
            place = self._place(own)
            self.keys[place] = own
            self.values[place] = scores
        return out

    @staticmethod
    def _place(packed: np.ndarray) -> np.ndarray:
        return (((packed * 40503) ^ (packed >> 17)) & (REMEMBERED - 1)).astype(np.int64)


def score(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) and bits_per_byte of every row.

    bits_per_byte spreads the whole score, white space and end included, over the text's bytes; it is null for an empty
    text. The rows are read four times and must come in the same order each time, as they do from files; stage others
    first (a block with another number of distinct entries raises an error; another order of as many does not show).
    The models learn from the rows where held is false. A null text counts as empty: one token, its end. Rows with equal
    ids are scored each for itself. Without training rows train_tokens is 0 and the scores are those of untrained models.
    An empty table gives an empty result; other columns are ignored. Texts are scored whole.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(held, F.lit(False)).alias("held_out"))
    counts = stage(count(rows.where(~F.col("held_out")), "text"), "lm-counts")
    words = counts.where("word is not null").select("word", "n")
    total = counts.agg(
        F.sum(F.when(F.col("word").isNotNull() | (F.col("gram") == -1), F.col("n"))).alias("N"), F.count("word").alias("V"), F.sum(F.when(F.col("gram") == -1, F.col("n"))).alias("ends")
    ).first()
    n_train, ends = total["N"] or 0, total["ends"] or 0
    below = float(np.log10(n_train + 0.5 * (total["V"] + (ends > 0) + 1)))
    head = most_frequent(words, HEAD).toArrow()
    shared = spark.sparkContext.broadcast((fit(counts), dict(zip(head.column(0).to_pylist(), np.log10(head.column(1).to_numpy() + 0.5).tolist(), strict=True))))

    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    asked = rows.select("text", "held_out").mapInArrow(recall.ask(byte_chunks, CHUNK, max(1, -(-size // recall.BUCKET))), recall.ASKED)
    answers = stage(asked.groupBy("bucket").applyInArrow(recall.answer, recall.ANSWERED), "lm-answers")
    tries, hits = np.zeros(recall.CLASSES), np.zeros(recall.CLASSES)
    for c, t, h in answers.where("class is not null").groupBy("class").agg(F.sum("tries"), F.sum("hits")).collect():
        tries[c], hits[c] = t, h
    begin = recall.starts(tries, hits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, known = shared.value
        scores, uid, kept = _Scores(mixer), TaskContext.get().partitionId() << 40, []
        for block, piece, first, part, over in recall.blocks(batches, byte_chunks, CHUNK):
            if part:
                packed, _ = byte_grams(part)
                at, hashed, n_units = recall.units(part)
                spelled = np.add.reduceat(scores.of(packed), at)
                n_tokens, head_sum, head_known, rare = [], [], [], []
                for x in part:
                    own = x.split()
                    values = list(map(known.get, own))
                    found = [v for v in values if v is not None]
                    rest = Counter(w for w, v in zip(own, values, strict=True) if v is None) if len(found) < len(own) else {}
                    n_tokens.append(len(own) + 1), head_sum.append(sum(found)), head_known.append(len(found))
                    rare.append([{"word": w, "tf": k} for w, k in rest.items()])
                uids = np.arange(uid, uid + len(part))
                uid += len(part)
                columns = [pa.array(uids), piece.column(1).slice(first, len(part)), piece.column(2).slice(first, len(part)), pa.array(n_tokens, type=pa.int64()), pa.array(head_sum, type=pa.float64()), pa.array(head_known, type=pa.int64()), pa.array(list(map(len, part)), type=pa.int64()), pa.array(rare, type=_RARE)]
                kept.append((recall.contexts(hashed, n_units), n_units, spelled, columns))
            if over:
                entry, n_units, spelled = (np.concatenate([k[i] for k in kept]) for i in range(3))
                order = np.argsort(entry)
                rank = np.empty(len(entry), dtype=np.uint32)
                rank[order] = np.cumsum(np.append(False, entry[order][1:] != entry[order][:-1]))
                cut = np.concatenate([[0], np.cumsum(n_units)])
                long = spelled < -LONGEST
                extra = np.add.reduceat(np.where(long, spelled + LONGEST, 0), cut[:-1])
                part_of = (
                    recall.slices(rank, cut), recall.slices((np.maximum(spelled, -LONGEST) / 64).astype(np.float16), cut),
                    recall.slices(recall.repeats(entry, n_units), cut), pa.array(extra),
                )
                done = 0
                for _, own, _, columns in kept:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block)), *columns, *(c.slice(done, len(own)) for c in part_of)], names=_TEXT)
                    done += len(own)
                kept = []

    def join(table: pa.Table) -> pa.Table:
        mine = pc.is_valid(table.column("answer"))
        own, table = table.filter(mine).sort_by("bucket"), table.filter(pc.invert(mine))
        byte = np.frombuffer(b"".join(own.column("answer").to_pylist()), dtype=np.uint8)
        rank, spelled, within = (np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=d) for c, d in (("rank", np.uint32), ("spelled", np.float16), ("within", np.uint8)))
        if len(byte) != rank.max() + 1:
            raise ValueError("the rows came in another order when they were read again; stage them first")
        found = recall.score(byte[rank], within, spelled.astype(float) * 64, table.column("n_tokens").to_numpy(), begin)
        return table.select(_TEXT[1:9]).append_column("score", pa.array(found + table.column("extra").to_numpy()))

    fields = f"uid long, id {kind}, held_out boolean, n_tokens long, head_sum double, head_known long, n_bytes long, rare array<struct<word:binary,tf:long>>"
    cut = rows.select("text", "id", "held_out").mapInArrow(run, f"block long, {fields}, rank binary, spelled binary, within binary, extra double")
    both = cut.unionByName(answers.where("block is not null").select("block", "bucket", "answer"), allowMissingColumns=True)
    scored = stage(both.groupBy("block").applyInArrow(join, f"{fields}, score double"), "lm-scores")
    rare = scored.select("uid", F.explode("rare").alias("r")).select("uid", "r.word", "r.tf").join(words, "word", "left")
    n = F.coalesce("n", F.lit(0))
    rare = rare.groupBy("uid").agg(F.sum(F.col("tf") * F.log10(n + 0.5)).alias("rare_sum"), F.sum(F.when(n > 0, F.col("tf")).otherwise(0)).alias("rare_known"))
    out = scored.drop("rare").join(rare, "uid", "left")
    base = F.col("head_sum") + F.coalesce("rare_sum", F.lit(0.0)) + float(np.log10(ends + 0.5)) - F.col("n_tokens") * below
    n_known = F.col("head_known") + F.coalesce("rare_known", F.lit(0)) + int(ends > 0)
    per_byte = F.when(F.col("n_bytes") > 0, -F.col("score") * float(np.log2(10)) / F.col("n_bytes"))
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", n_known.cast("long").alias("n_known"), F.lit(int(n_train)).cast("long").alias("train_tokens"), base.alias("base_score"), "score", per_byte.alias("bits_per_byte"))


_RARE = pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int64())]))
_TEXT = ["block", "uid", "id", "held_out", "n_tokens", "head_sum", "head_known", "n_bytes", "rare", "rank", "spelled", "within", "extra"]
