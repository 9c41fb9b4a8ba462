"""Quality rules: text statistics, and bands of n-gram perplexity under modified Kneser-Ney models.

A symbol is a UTF-16 unit, so the characters of every script are told apart and none is folded or left out (a character
beyond U+FFFF is two symbols); a gram of four symbols is one number of 64 bits. Each language has a model of its own,
however many languages there are, and a text is measured under the model of its language, learned from the language's other
texts: its own occurrences are taken out of all counts, so that noise does not vouch for itself.

The models grow with the corpus and are never held in one place. A task cuts its rows into blocks and asks for a block's
distinct grams and contexts with their counts; Spark adds up the counts of all blocks, derives the shorter grams and the
contexts from them, and joins them to what was asked. The answers and the rows meet by block, where they are the part of the
models that the block needs, in sorted arrays looked up by binary search. A text is measured in
windows, of which the median must lie in a band around its language's median.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import release, released, stage, text_chunks

#: Symbols of a gram, and bits of a symbol. NARROW bits tell apart a to z and the space; GRAMS is the number of such grams.
ORDER, BITS, NARROW = 4, 16, 5
GRAMS = 1 << NARROW * ORDER
#: Not a limit any more: languages without a model of their own. Each has one.
LANGUAGES = None
#: The spread of a language with fewer documents than this is at least that of all documents.
FEW = 20
#: Band: BAND times the spread (half the distance between the quartiles), widened for short texts by SHORT / sqrt(symbols).
BAND, SHORT = 3.0, 2.5
#: Symbols of a window.
WINDOW = 64
#: Characters handled at a time, and bytes of text in a block.
CHUNK, BLOCK = 1_000_000, 32_000_000
SPACES, MARKS = " \t\n\v\f\r", "#*$%&|<>"


def grams(part: list[str], bits: int = NARROW) -> tuple[np.ndarray, np.ndarray]:
    """Packed grams of the texts, one for each symbol and one for the end, and where each text's grams start.

    BITS bits hold a symbol whole; of fewer the low ones stay.
    """
    # Three edge symbols before each text and one after it.
    raw = np.frombuffer("".join("   " + x + " " for x in part).encode("utf-16-le"), dtype=np.uint16)
    sizes = np.fromiter((len(x) if x.isascii() else len(x.encode("utf-16-le")) // 2 for x in part), dtype=np.int64, count=len(part))
    s = raw.astype(np.uint64) & np.uint64((1 << bits) - 1)
    packed = s[3:].copy()
    for k in range(1, ORDER):
        packed |= s[3 - k : len(s) - k] << np.uint64(bits * k)
    first = np.concatenate([[0], np.cumsum(sizes + 4)])
    keep = np.ones(len(packed) + 3, dtype=bool)
    for k in range(1, 4):
        keep[first[1:] - k] = False  # these grams would reach into the next text
    packed = packed[keep[: len(packed)]]
    return packed if bits == BITS else packed.astype(np.int64), first[:-1] - 3 * np.arange(len(part))


def base_rules(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text."""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, MARKS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)] if "\n" in text else ()
    repeated = 0
    if n > 5:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
        if len(set(windows)) < len(windows):
            seen, end = Counter(windows), 0
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    repeated += i + 5 - max(i, end)
                    end = i + 5
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


_ORDER_CHANGED = "the rows came in another order when they were read again; stage them first"


class KneserNey:
    """A language's interpolated modified Kneser-Ney model, or the part of it that some texts need, in sorted arrays.

    keys[k]: grams of k symbols; count[k]: how often each occurs (k = ORDER), or how many longer grams end with it;
    after[k]: of each as a context, the sum of the counts of the grams that continue it, and how many of these have count
    1, 2 and more; discounts[k]: what a count of 1, 2 and more loses. Each array ends with zeros, for grams not held.
    """

    def __init__(self, gram: np.ndarray, n: np.ndarray, bits: int = NARROW):
        keys, count = np.asarray(gram).astype(np.uint64), np.asarray(n, dtype=float)
        after = np.zeros((4, len(keys)))
        self._start(bits)
        for k in range(ORDER, 0, -1):
            self._put(k, keys, count, after)
            self.discounts[k] = discounts([float((count == j).sum()) for j in (1, 2, 3, 4)])
            held, count = keys[count > 0], count[count > 0]
            suffix, prefix = held & self._mask(k - 1), held >> np.uint64(bits)
            keys = np.union1d(suffix, prefix)
            at = np.searchsorted(keys, prefix)
            after = np.stack([np.bincount(at, weights=w, minlength=len(keys)) for w in (count, count == 1, count == 2, count > 2)])
            count = np.bincount(np.searchsorted(keys, suffix), minlength=len(keys)).astype(float)
        self._put(0, keys, count, after)

    @classmethod
    def of_rows(cls, k: np.ndarray, key: np.ndarray, values: np.ndarray) -> KneserNey:
        """From NODES: values has a row for each of count, whole, one, two, more."""
        self = cls.__new__(cls)
        self._start(BITS)
        order = np.lexsort((key, k))
        k, key, values = k[order], key[order], values[:, order]
        for j in range(ORDER + 1):
            a, b = np.searchsorted(k, [j, j + 1])
            self._put(j, key[a:b], values[0, a:b], values[1:, a:b])
            if j:
                at = int(np.searchsorted(k, -j))
                self.discounts[j] = discounts(values[:4, at].tolist())
        self.suffix = [None, *(self.at(j - 1, self.keys[j][:-1] & self._mask(j - 1)) for j in range(1, ORDER + 1))]
        self.prefix = [None, *(self.at(j - 1, self.keys[j][:-1] >> np.uint64(BITS)) for j in range(1, ORDER + 1))]
        return self

    def _start(self, bits: int) -> None:
        self.bits, self.discounts = bits, {}
        self.keys, self.count, self.after = ([None] * (ORDER + 1) for _ in range(3))

    def _mask(self, k: int) -> np.uint64:
        return np.uint64((1 << self.bits * k) - 1)

    def _put(self, k: int, keys: np.ndarray, count: np.ndarray, after: np.ndarray) -> None:
        self.keys[k] = np.append(keys, np.uint64(2**64 - 1))
        self.count[k] = np.append(count, 0.0)
        self.after[k] = np.column_stack([after, np.zeros(4)])

    def at(self, k: int, wanted: np.ndarray) -> np.ndarray:
        """Places of grams of k symbols; the last place for those not held."""
        keys = self.keys[k][:-1]
        if not len(keys):
            return np.zeros(len(wanted), dtype=np.int64)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, at, len(keys))

    def _p(self, k: int, count: np.ndarray, after: np.ndarray, lower: np.ndarray) -> np.ndarray:
        d = np.append(0.0, self.discounts[k])
        some = after[0] > 0
        whole = np.where(some, after[0], 1.0)
        p = (count - d[np.minimum(count, 3).astype(int)] + (d[1:] @ after[1:]) * lower) / whole
        return np.where(some, p, lower)

    def score(self, packed: np.ndarray) -> np.ndarray:
        """log2 probability of each gram's last symbol after the others."""
        p, packed = np.full(len(packed), 2.0**-self.bits), np.asarray(packed).astype(np.uint64)
        for k in range(1, ORDER + 1):
            gram = packed & self._mask(k)
            p = self._p(k, self.count[k][self.at(k, gram)], self.after[k - 1][:, self.at(k - 1, gram >> np.uint64(self.bits))], p)
        return np.log2(p)

    def held_out(self, packed: np.ndarray, text: np.ndarray) -> np.ndarray:
        """score() of grams that the model holds, those of a gram's text taken out of the counts; the discounts stay.

        A gram of which nothing remains no longer counts among those that end with its suffix, and so on down.
        """
        at, size = self.at(ORDER, packed), len(self.keys[ORDER])
        if (at == size - 1).any():
            raise ValueError(_ORDER_CHANGED)
        entry, back, lost = np.unique(text * size + at, return_inverse=True, return_counts=True)
        own, at, levels = entry // size, entry % size, []
        for k in range(ORDER, 0, -1):
            count = self.count[k][at]
            left = count - lost
            size = len(self.keys[k - 1])
            place, of = np.unique(own * size + self.prefix[k][at], return_inverse=True)
            after = self.after[k - 1][:, place % size]
            before, now = np.minimum(count, 3), np.minimum(left, 3)
            after[0] -= np.bincount(of, weights=lost, minlength=len(place))
            for j in (1, 2, 3):
                after[j] += np.bincount(of, weights=(now == j).astype(float) - (before == j), minlength=len(place))
            entry, up = np.unique(own * size + self.suffix[k][at], return_inverse=True)
            levels.append((k, left, after, of, up))
            lost = np.bincount(up, weights=left == 0, minlength=len(entry))
            own, at = entry // size, entry % size
        p = np.full(len(entry), 2.0**-self.bits)
        for k, left, after, of, up in reversed(levels):
            p = self._p(k, left, after[:, of], p[up])
        return np.log2(p)[back]


def discounts(n: Sequence[float]) -> np.ndarray:
    """Of counts of 1, 2 and more, from how many grams have count 1, 2, 3 and 4."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3):
        return np.array([0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    return np.clip([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0.05, 0.05, 0.05], [0.95, 1.95, 2.95])


def typical(gram: np.ndarray, start: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """Bits a symbol of each text: the median of its windows, so that a quotation or a number does not count against it.

    A run of one symbol counts as one symbol; otherwise a run, which costs little, would hide what stands before it.
    """
    n = np.diff(np.append(start, len(gram)))
    windows = np.maximum(1, n // WINDOW)
    first = np.cumsum(windows) - windows
    cuts = np.repeat(start - WINDOW * first, windows) + WINDOW * np.arange(windows.sum())
    new = (gram ^ (gram >> np.uint64(BITS))) & np.uint64((1 << BITS) - 1) != 0
    bits = -np.add.reduceat(log_p, cuts) / np.maximum(1, np.add.reduceat(new.astype(np.int64), cuts))
    bits = bits[np.lexsort((bits, np.repeat(np.arange(len(n)), windows)))]
    return (bits[first + (windows - 1) // 2] + bits[first + windows // 2]) / 2


def _blocks(batches: Iterator[pa.RecordBatch], at: int, chunk: int, size: int) -> Iterator[tuple[int, pa.RecordBatch, list[str], bool]]:
    """(block, rows, texts, whether a new block begins) of runs of consecutive rows. Column 0 is the row, 1 its language."""
    block, total, new = TaskContext.get().partitionId() << 32, 0, True
    for batch in batches:
        for first, part in text_chunks(batch.column(0).field(at), chunk):
            yield block, batch.slice(first, len(part)), part, new
            total, new = total + sum(map(len, part)), False
            if total >= size:
                block, total, new = block + 1, 0, True


def _by_language(langs: list[str], part: list[str]) -> Iterator[tuple[str, list[int], list[str]]]:
    places: dict[str, list[int]] = {}
    for i, x in enumerate(langs):
        places.setdefault(x, []).append(i)
    for lang, own in places.items():
        yield lang, own, [part[i] for i in own]


ASKED = "block long, lang string, k int, key long, n long"


def _ask(rows: DataFrame, at: int) -> DataFrame:
    """ASKED: the distinct grams of each block's texts with their counts (k = ORDER), the shorter grams and the contexts in
    them (k from 0), and the discounts of each length (k below 0)."""
    sizes = CHUNK, BLOCK

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, kept = 0, {}
        for block_, piece, part, new in _blocks(batches, at, *sizes):
            if new:
                yield from asked(block, kept)
                block, kept = block_, {}
            for lang, _, own in _by_language(piece.column(1).to_pylist(), part):
                kept.setdefault(lang, []).append(np.unique(grams(own, BITS)[0], return_counts=True))
        yield from asked(block, kept)

    def asked(block: int, kept: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for lang, seen in kept.items():
            keys, of = np.unique(np.concatenate([x[0] for x in seen]), return_inverse=True)
            n = np.bincount(of, weights=np.concatenate([x[1] for x in seen])).astype(np.int64)
            yield record(block, lang, ORDER, keys, n)
            for k in range(ORDER - 1, -1, -1):
                keys = np.unique(np.concatenate([keys & np.uint64((1 << BITS * k) - 1), keys >> np.uint64(BITS)]))
                yield record(block, lang, k, keys, np.zeros(len(keys), dtype=np.int64))
            for k in range(1, ORDER + 1):
                yield record(block, lang, -k, np.zeros(1, dtype=np.uint64), np.zeros(1, dtype=np.int64))

    def record(block: int, lang: str, k: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        size = len(keys)
        return pa.RecordBatch.from_arrays([pa.array(np.full(size, block)), pa.array([lang] * size, type=pa.string()), pa.array(np.full(size, k, dtype=np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], names=["block", "lang", "k", "key", "n"])

    return stage(rows.mapInArrow(run, ASKED), "quality-asked")


NODES = ["lang", "k", "key", "count", "whole", "one", "two", "more"]


def _nodes(asked: DataFrame) -> DataFrame:
    """NODES: the models of all languages. A gram of k symbols, its count and what follows it; k below 0: how many grams of
    -k symbols have count 1, 2, 3 and 4, in count, whole, one and two."""
    level = stage(asked.where(F.col("k") == ORDER).groupBy("lang", "key").agg(F.sum("n").alias("count")), "quality-grams")
    none, parts = [F.lit(0).cast("long").alias(c) for c in NODES[4:]], []
    for k in range(ORDER, 0, -1):
        having = [F.count_if(F.col("count") == j) for j in (1, 2, 3, 4)]
        parts.append(level.select("lang", F.lit(k).alias("k"), "key", "count", *none))
        context = F.shiftrightunsigned("key", BITS) if k > 1 else F.lit(0).cast("long")
        parts.append(level.groupBy("lang", context.alias("key")).agg(F.sum("count").alias("whole"), having[0].alias("one"), having[1].alias("two"), F.count_if(F.col("count") > 2).alias("more")).select("lang", F.lit(k - 1).alias("k"), "key", F.lit(0).cast("long").alias("count"), "whole", "one", "two", "more"))
        parts.append(level.groupBy("lang").agg(*(x.alias(c) for x, c in zip(having, NODES[3:], strict=False))).select("lang", F.lit(-k).alias("k"), F.lit(0).cast("long").alias("key"), *NODES[3:7], none[3]))
        level = level.groupBy("lang", F.col("key").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1)).alias("key")).agg(F.count("*").alias("count"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.groupBy(*NODES[:3]).agg(*(F.sum(c).alias(c) for c in NODES[3:]))


def _pack(rows: DataFrame, at: int) -> DataFrame:
    """block, rows: the same blocks, each run of rows as one compressed Arrow stream."""
    sizes = CHUNK, BLOCK

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for block, piece, _, _ in _blocks(batches, at, *sizes):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, piece.schema, options=options) as writer:
                writer.write_batch(piece)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([sink.getvalue().to_pybytes()], type=pa.binary())], names=["block", "rows"])

    return rows.mapInArrow(run, "block long, rows binary")


def measure(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", carry: Sequence[str] | None = None) -> DataFrame:
    """row (the input row, or its columns named in carry), the base statistics, n_grams and bits (log2 perplexity a symbol;
    null if no word). The rows are read twice and must come in the same order, as they do from files; otherwise it is an error."""
    carry = list(carry or docs.columns)
    names = list(dict.fromkeys([*carry, text_col]))
    at, kept = names.index(text_col), [names.index(c) for c in carry]
    # A null language is a language of its own, also beside an empty name.
    lang = F.coalesce(F.concat(F.lit("="), F.col(lang_col).cast("string")), F.lit(""))
    rows = docs.select(F.struct(*names).alias("row"), lang.alias("lang"))
    asked = _ask(rows, at)
    answers = asked.select("block", "lang", "k", "key").join(_nodes(asked), NODES[:3])
    n_blocks = asked.where("k = 0").select("block").distinct().count()

    def measured(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            raise ValueError(_ORDER_CHANGED)
        models, out = {}, []
        for packed in left.column("rows"):
            for piece in pa.ipc.open_stream(packed.as_buffer()):
                row = piece.column(0)
                part = [x or "" for x in row.field(at).to_pylist()]
                n_grams, bits = np.zeros(len(part), dtype=np.int64), np.zeros(len(part))
                for lang, own, texts in _by_language(piece.column(1).to_pylist(), part):
                    if lang not in models:
                        mine = right.filter(pc.equal(right.column("lang"), lang))
                        models[lang] = KneserNey.of_rows(mine.column("k").to_numpy(), mine.column("key").to_numpy().view(np.uint64), np.stack([mine.column(c).to_numpy().astype(float) for c in NODES[3:]]))
                    gram, start = grams(texts, BITS)
                    n = np.diff(np.append(start, len(gram)))
                    n_grams[own] = n
                    bits[own] = typical(gram, start, models[lang].held_out(gram, np.repeat(np.arange(len(n)), n)))
                base = [base_rules(x) for x in part]
                bits[[b[0] == 0 for b in base]] = np.nan
                fields = [row.type.field(i) for i in kept]
                carried = pa.StructArray.from_arrays([row.field(i) for i in kept], fields=fields)
                columns = [carried, *(pa.array([b[k] for b in base], type=pa.int64()) for k in range(5)), pa.array(n_grams), pa.array(bits, from_pandas=True)]
                out.append(pa.RecordBatch.from_arrays(columns, names=_MEASURED))
        return pa.Table.from_batches(out)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = measured(left, right)
        release()
        return out

    schema = StructType(docs.select(F.struct(*carry).alias("row")).schema.fields)
    for c in _MEASURED[1:]:
        schema = schema.add(c, "double" if c == "bits" else "long")
    both = _pack(rows, at).repartition(max(1, 2 * n_blocks), "block").groupBy("block").cogroup(answers.groupBy("block"))
    return both.applyInArrow(run, schema)


_MEASURED = ["row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_grams", "bits"]


def bands(measured: DataFrame, lang_col: str = "lang") -> DataFrame:
    """lang, middle and spread of the bits of each language's documents that pass the base rules; a staged table.

    middle is the median, spread half the distance between the quartiles; the quartiles of fewer than FEW documents say
    little, so there the spread is at least that of all documents. One pass, added up before the shuffle.
    """
    q = F.percentile_approx("bits", [0.25, 0.5, 0.75], 10000)
    good = measured.where(~_failed() & F.col("bits").isNotNull()).select(F.col("row")[lang_col].alias("lang"), "bits")
    rows = good.rollup("lang").agg(q.alias("q"), F.count("*").alias("n"), F.grouping("lang").alias("whole"))
    rows = stage(rows.select("lang", F.col("q")[1].alias("middle"), ((F.col("q")[2] - F.col("q")[0]) / 2).alias("spread"), "n", "whole"), "bands")
    whole = rows.where("whole = 1").first()
    least = F.when(F.col("n") < FEW, F.lit(whole["spread"] if whole else 0.0)).otherwise(0.0)
    return rows.where("whole = 0").select("lang", "middle", F.greatest("spread", least).alias("spread"))


def judge(measured: DataFrame, lang_col: str = "lang", band: float = BAND, short: float = SHORT) -> DataFrame:
    """Add base_failed and kept. measured must be staged, since it is read twice.

    A document is kept if it passes the base rules and its bits lie within band spreads of its language's median, plus
    short / sqrt(n_grams) for the noise of short texts. The bands, a row for each language, are a table of known size,
    which Spark broadcasts only if it is small.
    """
    own = bands(measured, lang_col)
    inside = F.abs(F.col("bits") - F.col("middle")) <= band * F.col("spread") + short / F.sqrt("n_grams")
    joined = measured.join(own, F.col("row")[lang_col].eqNullSafe(F.col("lang")), "left")
    return joined.select(*measured.columns, _failed().alias("base_failed"), (~_failed() & F.coalesce(inside, F.lit(False))).alias("kept"))


def _failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def check(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", band: float = BAND, short: float = SHORT, carry: Sequence[str] | None = None) -> DataFrame:
    """Statistics and verdict of every row: row (the input row) and the columns of measure() and judge().

    carry names the columns that row holds, the language among them; all of them if it is not given.

    A row for each row, repeated ones included. A null text has no words and fails the base rules, as does an empty one.
    A null language is a language of its own; every language has its own model and band. An empty table gives an empty
    result. Other columns travel inside row, so that no name can clash.
    """
    return judge(stage(measure(docs, text_col, lang_col, carry), "quality"), lang_col, band, short)


def keep(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows that check() keeps, with their own columns."""
    return check(docs, text_col, lang_col).where("kept").select("row.*")
