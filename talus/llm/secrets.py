"""Secret scans: three base patterns, and a linear-chain conditional random field over tokens.

Tokens are runs of anything but ASCII white space. The field tags each as begin, inside or outside of a secret from its
own shape, its neighbours and features of the whole file. It is trained in this module, by gradient ascent on the
conditional likelihood of a generated corpus, and decoded by Viterbi.

Decoding stays exact and cheap by this bound: with r the spread of the transition weights, a token whose "outside" score
leads by more than 2 r is outside on the best path (setting it to outside changes two transitions at most). Such tokens
cut the chain, and Viterbi runs over the short stretches between them.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, text_chunks

BASE_KINDS = ("assign", "access", "hex")
KINDS = BASE_KINDS + ("crf",)
SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
#: Bytes handled at a time.
CHUNK = 1_000_000
B, I, O = range(3)
#: Generated training files, their seed, and passes over them.
TRAIN_FILES, TRAIN_SEED, TRAIN_STEPS = 700, 7, 150

_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_ASSIGN_CUES = (b"passw", b"secret", b"token", b"api")
CUES = (b"passw", b"pwd", b"secret", b"token", b"key", b"bearer", b"credential", b"auth")
_SPACE, _LOWER, _UPPER, _DIGIT, _MARK, _OTHER, _HIGH = range(7)
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[128:] = _HIGH
for _set, _kind in ((b" \t\n\v\f\r", _SPACE), (b"abcdefghijklmnopqrstuvwxyz", _LOWER), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), (b"0123456789", _DIGIT), (b"+/_=-", _MARK)):
    _CLASS[list(_set)] = _kind
_HEX = np.zeros(256, dtype=bool)
_HEX[list(b"0123456789abcdef")] = True
#: Features, each a column of small integers, with their number of values.
WIDTHS = (8, 6, 6, 6, 6, 6, 4, 4, 4, 4, 4, 4)
_OFFSETS = np.concatenate([[0], np.cumsum(WIDTHS)[:-1]])


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """0 for none, 5 for all, 1 to 4 between."""
    return np.where(part == 0, 0, np.where(part == whole, 5, 1 + np.minimum(3, 4 * part // np.maximum(whole, 1))))


def features(raw: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token starts, ends, file numbers and feature rows. Files lie in raw at bounds[i]:bounds[i + 1], white space between."""
    a = np.frombuffer(raw, dtype=np.uint8)
    kind = _CLASS[a]
    inside = np.concatenate([[False], kind != _SPACE, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return start, end, start, np.zeros((0, len(WIDTHS)), dtype=np.int32)
    size = end - start

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.cumsum(mask, dtype=np.int32)
        return np.concatenate([[0], total])[end] - np.concatenate([[0], total])[start]

    lower, upper, digit, mark, other = (count(kind == k) for k in (_LOWER, _UPPER, _DIGIT, _MARK, _OTHER))
    # Changes between letters, digits and marks: frequent in random strings, rare in words.
    turn = count(np.concatenate([[False], (kind[1:] != kind[:-1])]))
    file = np.searchsorted(bounds, start, side="right") - 1
    cue = np.zeros(len(start), dtype=bool)
    low = raw.lower()
    for word in CUES:
        at = low.find(word)
        while at >= 0:
            cue[np.searchsorted(start, at, side="right") - 1] = True
            at = low.find(word, at + 1)
    last = a[end - 1]
    assigns = np.isin(last, list(b"=:"))
    inner = (other + mark > 0) & ~assigns
    before = lambda x, by: np.where((np.arange(len(x)) >= by) & (np.roll(file, by) == file), np.roll(x, by), 0)
    after = lambda x: np.where((np.arange(len(x)) < len(x) - 1) & (np.roll(file, -1) == file), np.roll(x, -1), 0)
    random_like = ((turn >= 4) & (digit > 0) & (size >= 8)).astype(np.int64)
    n_files = len(bounds) - 1
    tokens_in = np.maximum(np.bincount(file, minlength=n_files), 1)
    code = np.bincount(file, weights=assigns, minlength=n_files) / tokens_in
    digits = np.bincount(file, weights=digit, minlength=n_files) / np.maximum(np.bincount(file, weights=size, minlength=n_files), 1)
    buckets = lambda x, cuts: np.searchsorted(cuts, x, side="right")[file]
    columns = (
        np.minimum(7, np.searchsorted([4, 8, 12, 16, 20, 32, 64], size, side="right")),
        _share(digit, size),
        _share(upper, size),
        _share(lower, size),
        _share(lower + upper + digit + mark, size),
        np.searchsorted([1, 3, 5, 8, 12], turn, side="right"),
        cue + 2 * inner,
        before(cue, 1) + 2 * before(assigns, 1),
        before(cue, 2) + 2 * before(random_like, 1),
        after(cue) + 2 * after(random_like),
        buckets(code, [0.001, 0.01, 0.1]),
        buckets(digits, [0.001, 0.02, 0.1]),
    )
    return start, end, file, np.stack([c.astype(np.int32) for c in columns], axis=1)


class Field:
    """Linear-chain CRF with weights emit[feature value, label] and step[label, next label]."""

    def __init__(self, emit: np.ndarray, step: np.ndarray):
        self.emit, self.step = emit, step

    def scores(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), 3), dtype=np.float32)
        for k, offset in enumerate(_OFFSETS):
            out += self.emit[offset + rows[:, k]]
        return out

    def tag(self, rows: np.ndarray, file: np.ndarray) -> np.ndarray:
        """The best labels, file by file."""
        score = self.scores(rows)
        label = np.full(len(rows), O, dtype=np.int8)
        lead = score[:, O] - np.maximum(score[:, B], score[:, I])
        open_ = np.flatnonzero(lead <= 2 * (self.step.max() - self.step.min()))
        if not len(open_):
            return label
        cut = np.flatnonzero((np.diff(open_) > 1) | (np.diff(file[open_]) != 0)) + 1
        for part in np.split(open_, cut):
            a, b = part[0], part[-1]
            first = a == 0 or file[a - 1] != file[a]
            final = b + 1 == len(file) or file[b + 1] != file[b]
            label[a : b + 1] = self.viterbi(score[a : b + 1], first, final)
        return label

    def viterbi(self, score: np.ndarray, first: bool = True, final: bool = True) -> list[int]:
        """Best labels of a stretch; its neighbours, unless it is first or final in the file, are outside."""
        best, back, step = score[0] + (0 if first else self.step[O]), [], self.step
        for x in score[1:]:
            way = best[:, None] + step
            back.append(way.argmax(0))
            best = way.max(0) + x
        out = [int((best + (0 if final else step[:, O])).argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]


def _generated(seed: int, n: int) -> tuple[list[list[tuple[str, int]]], random.Random]:
    """Files of (token, label): invented prose, code and numbers, with secrets of many forms."""
    r = random.Random(seed)
    letters, alnum, b64 = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    of = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    syllables = [of(letters, r.randint(1, 4)) for _ in range(150)] + ["é", "über", "ción", "eau", "ß", "ñ"]

    def word() -> str:
        w = "".join(r.choice(syllables) for _ in range(r.choice((1, 1, 2, 2, 3, 5, 9))))
        w = r.choice((w, w, w, w, w.capitalize(), w.upper())) + r.choice(("", "", "", ".", ",", "###", "!!!", ":", "|"))
        return w

    def plain() -> str:
        kind = r.random()
        if kind < 0.86:
            return word()
        return r.choice((
            lambda: of("0123456789", r.randint(1, 17)), lambda: f"{of(letters, 6)}.{r.randint(1, 99)}@mail{r.randint(1, 9)}.example.com", lambda: f"https://{of(letters, 8)}.example.org/{of(letters, 6)}/{r.randint(1, 9999)}?page={r.randint(1, 9)}",
            lambda: f"{r.randint(1, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}", lambda: f"20{r.randint(10, 29)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}", lambda: "#" + of("0123456789abcdef", 6), lambda: f"{of(letters, 4)}_{of(letters, 5)}({of(letters, 3)})", lambda: f"v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}",
            lambda: r.choice(("token", "key", "password", "secret", "monkey", "keyboard", "author", "tokens", "the", "=", ":", "-", "|")), lambda: f"+1 ({r.randint(200, 999)}) 555-{of('0123456789', 4)}", lambda: f"<p>{word()}</p>", lambda: "-" * r.randint(2, 40), lambda: of("#*$%&!|", r.randint(2, 9)),
        ))()

    def secret() -> list[tuple[str, int]]:
        value = r.choice((lambda: of("0123456789abcdef", r.choice((20, 24, 32, 40, 64))), lambda: of(b64, r.randint(20, 60)) + r.choice(("", "=", "==")), lambda: "AKIA" + of(alnum.upper(), 16), lambda: r.choice(("ghp_", "sk-", "xoxb-", "glpat-", "pk_live_")) + of(alnum, r.randint(20, 40)), lambda: ".".join(of(alnum + "-_", k) for k in (20, 40, 30)), lambda: of(alnum + "!@#$%^&*-_", r.randint(10, 24))))()
        quote = r.choice(("", "", '"', "'"))
        cue = r.choice(("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "auth_token", "ACCESS_KEY", "Authorization", "client_secret", "credentials"))
        form = r.randrange(6)
        if form == 0:
            return [(f"{cue}{r.choice('=:')}{quote}{value}{quote}", B)]
        if form == 1:
            return [(cue, O), (r.choice("=:"), O), (f"{quote}{value}{quote}{r.choice(('', ',', ';'))}", B)]
        if form == 2:
            return [(cue + r.choice("=:"), O), (f"{quote}{value}{quote}", B)]
        if form == 3:
            return [("Authorization:", O), ("Bearer", O), (value, B)]
        if form == 4:
            return [(of("0123456789abcdef", r.choice((32, 40))) if r.random() < 0.5 else "AKIA" + of(alnum.upper(), 16), B)]
        return [("-----BEGIN", B), ("PRIVATE", I), ("KEY-----", I), *((of(b64, 64), I) for _ in range(r.randint(2, 6))), ("-----END", I), ("PRIVATE", I), ("KEY-----", I)]

    files = []
    for _ in range(n):
        out = [(t, O) for _ in range(r.randint(5, 60)) for t in plain().split()]
        for _ in range(r.choice((0, 0, 1, 1, 2))):
            at = r.randint(0, len(out))
            out[at:at] = [(t, y) for x, y in secret() for t in x.split()]
        files.append(out)
    return files, r


def train(files: list[list[tuple[str, int]]], steps: int = TRAIN_STEPS, penalty: float = 1e-3, rate: float = 0.15) -> Field:
    """Maximise the conditional likelihood (forward-backward over all files at once; Adam)."""
    rows, labels, sizes = _rows(files)
    longest, starts = max(sizes), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    index = np.minimum(starts[:, None] + np.arange(longest), len(rows) - 1)
    mask = np.arange(longest) < np.array(sizes)[:, None]
    y = np.where(mask, labels[index], O)
    flat = rows + _OFFSETS
    emit, step = np.zeros((sum(WIDTHS), 3)), np.zeros((3, 3))
    gold_emit, gold_step = np.zeros_like(emit), np.zeros_like(step)
    for k in range(flat.shape[1]):
        np.add.at(gold_emit, (flat[:, k], labels), 1)
    both = mask[:, 1:]
    np.add.at(gold_step, (y[:, :-1][both], y[:, 1:][both]), 1)
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (emit, step)]
    for t in range(1, steps + 1):
        score = emit[flat].sum(1)[index]
        n = len(files)
        alpha, beta = np.zeros((longest, n, 3)), np.zeros((longest, n, 3))
        alpha[0] = score[:, 0]
        for i in range(1, longest):
            alpha[i] = np.where(mask[:, i, None], score[:, i] + np.logaddexp.reduce(alpha[i - 1][:, :, None] + step, axis=1), alpha[i - 1])
        for i in range(longest - 2, -1, -1):
            beta[i] = np.where(mask[:, i + 1, None], np.logaddexp.reduce(step + (score[:, i + 1] + beta[i + 1])[:, None, :], axis=2), beta[i + 1])
        total = np.logaddexp.reduce(alpha[-1], axis=1)
        p = np.exp(alpha + beta - total[:, None])
        node = p.transpose(1, 0, 2)[mask]
        hope_emit = np.zeros_like(emit)
        for k in range(flat.shape[1]):
            for c in range(3):
                hope_emit[:, c] += np.bincount(flat[:, k], weights=node[:, c], minlength=len(emit))
        pair = np.exp(alpha[:-1][..., None] + step + (score.transpose(1, 0, 2)[1:] + beta[1:])[:, :, None, :] - total[:, None, None])
        hope_step = (pair * both.T[..., None, None]).sum((0, 1))
        for x, g, (m, v) in zip((emit, step), ((gold_emit - hope_emit) / n, (gold_step - hope_step) / n), state, strict=True):
            g -= penalty * x
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Field(emit.astype(np.float32), step.astype(np.float32))


def _rows(files: list[list[tuple[str, int]]]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    raw = [" ".join(t for t, _ in f).encode() + b"\n" for f in files]
    rows = features(b"".join(raw), np.concatenate([[0], np.cumsum(list(map(len, raw)))]))[3]
    return rows, np.array([y for f in files for _, y in f]), [len(f) for f in files]


@lru_cache(maxsize=1)
def trained() -> Field:
    """The field that the scan uses, trained on TRAIN_FILES generated files."""
    return train(_generated(TRAIN_SEED, TRAIN_FILES)[0])


def _base(raw: bytes, low: bytes, hexes: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    out = []
    if any(c in low for c in _ASSIGN_CUES):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(raw) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        out += [("access", *m.span()) for m in _ACCESS.finditer(raw) if len(m[0]) >= 20]
    return out + [("hex", a, b) for a, b in hexes]


def scan(items: list[str], field: Field) -> list[list[tuple[str, int, int]]]:
    """Spans of each text as (kind, start, end) in code points, by start, then kind as listed.

    A stretch of tokens that the field tags and that does not lie inside one base span is a span of kind crf, without the
    quotes and brackets around it; it may overlap base spans, which stay.
    """
    parts = [x.encode() + b"\n" for x in items]
    raw, bounds = b"".join(parts), np.concatenate([[0], np.cumsum(list(map(len, parts)))]).astype(np.int64)
    start, end, file, rows = features(raw, bounds)
    stop = np.flatnonzero(~_HEX[np.frombuffer(raw, dtype=np.uint8)])
    stop = np.concatenate([[-1], stop])
    long_ = np.flatnonzero(np.diff(stop) > 24)
    hexes: dict[int, list[tuple[int, int]]] = {}
    for a, b in zip((stop[long_] + 1).tolist(), stop[long_ + 1].tolist(), strict=True):
        i = int(np.searchsorted(bounds, a, side="right")) - 1
        hexes.setdefault(i, []).append((a - int(bounds[i]), b - int(bounds[i])))
    label = field.tag(rows, file)
    tagged: dict[int, list[list[int]]] = {}
    before = -2
    for k in np.flatnonzero(label != O).tolist():
        i = int(file[k])
        own = tagged.setdefault(i, [])
        if label[k] == I and before == k - 1 and own:
            own[-1][1] = int(end[k] - bounds[i])
        else:
            own.append([int(start[k] - bounds[i]), int(end[k] - bounds[i])])
        before = k
    out = []
    for i, part in enumerate(parts):
        spans = _base(part, part.lower(), hexes.get(i, []))
        base = list(spans)
        for a, b in tagged.get(i, ()):
            while a < b and part[a] in b"\"'([{<`,;":
                a += 1
            while a < b and part[b - 1] in b"\"')]}>`,;.":
                b -= 1
            if a < b and not any(x <= a and b <= y for _, x, y in base):
                spans.append(("crf", a, b))
        if spans and len(part) != len(items[i]) + 1:  # to code points
            point = np.concatenate([[0], np.cumsum((np.frombuffer(part, dtype=np.uint8) & 0xC0) != 0x80)])
            spans = [(k, int(point[a]), int(point[b])) for k, a, b in spans]
        out.append(sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))
    return out


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets in every text: id and spans (kind, start, end in code points; by start, then kind as listed).

    A row for each row. A null or empty text has no spans; texts are read whole; repeated rows give equal results; other
    columns are ignored.
    """
    kind, field = docs.schema[id_col].dataType.simpleString(), trained()

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in text_chunks(batch.column(1), CHUNK):
                spans = [[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in scan(part, field)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), pa.array(spans, type=_SPANS)], names=[id_col, "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, spans {SPANS}")


def redact(docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns, each secret in the text replaced by [SECRET] and size_col, if there, brought up to date.

    Rows are never dropped; a null text stays null. Overlapping spans are replaced as one.
    """
    field, names, schema = trained(), docs.columns, docs.schema
    at = names.index(text_col)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[str | None] = []
            for _, part in text_chunks(batch.column(at), CHUNK):
                out += [_replaced(x, s) for x, s in zip(part, scan(part, field), strict=True)]
            old = batch.column(at)
            out = [x if ok else None for x, ok in zip(out, old.is_valid().to_pylist(), strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, type=old.type))

    out = docs.mapInArrow(run, schema)
    if size_col in names:
        out = out.withColumn(size_col, F.coalesce(F.char_length(text_col), F.col(size_col)).cast(schema[size_col].dataType))
    return out


def _replaced(text: str, spans: list[tuple[str, int, int]]) -> str:
    if not spans:
        return text
    out, over = [], 0
    for _, a, b in spans:
        if a >= over:
            out += [text[over:a], "[SECRET]"]
        over = max(over, b)
    return "".join(out) + text[over:]
