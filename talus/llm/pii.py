"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, scheme marks, plus signs, digits and
identifier cues. At each anchor a deterministic local parser expands to the value's boundaries and validates it. The
parsers never look further than the value itself, so a text costs time in proportion to its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_chunks

#: Base kinds in their order, then the kinds that cues add.
BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("url", "iban", "account")
KINDS = BASE_KINDS + MORE_KINDS
IBAN_CUES = ("iban",)
ACCOUNT_CUES = ("account", "acct", "passport", "ssn", "social security", "konto", "kontonummer", "cuenta", "compte", "customer id", "driver license")
SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Bytes of text that are held as Python objects at a time.
CHUNK = 1_000_000
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_AUTHORITY = re.compile(r"[^\s/?#@\"'<>]+@[^\s/?#\"'<>]+")
_IBAN = re.compile(r"[\s:#=.-]{0,4}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})")
_ACCOUNT = re.compile(r"(?:\x20?(?:number|num|no|nr))?[\x20.:#=-]{0,4}([A-Z]{0,2}[0-9](?:[\x20-]?[0-9]){5,19})(?![0-9])")


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in [("@", "@"), ("://", ":"), ("+", "+"), *((d, "0") for d in "0123456789")]:
        found.add_word(word, kind)
    for kind, cues in (("iban", IBAN_CUES), ("account", ACCOUNT_CUES)):
        for cue in cues:
            for form in (cue, cue.upper(), cue.title(), cue.capitalize()):
                found.add_word(form, kind)
    found.make_automaton()
    return found


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def scan(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text as (kind, start, end) in code points, by kind, then start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    over = dict.fromkeys(KINDS, 0)  # where the last match of a kind ended
    for at, kind in _anchors().iter(text):
        if kind == "0":
            if at >= over["card"] and (m := _CARD.match(text, at)):
                over["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and _luhn(digits):
                    found["card"].append(m.span())
            if at >= over["ip"]:
                if m := _IP.match(text, at):
                    over["ip"] = m.end()
                    if all(len(p := x.lstrip("0")) < 3 or len(p) == 3 and p <= "255" for x in m[0].split(".")):
                        found["ip"].append(m.span())
                else:  # no later start in this run of digits can match either
                    over["ip"] = _DIGITS.match(text, at).end()
        elif kind == "@":
            start, least = at, over["email"]
            while start > least and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                found["email"].append((start, m.end()))
                over["email"] = m.end()
        elif kind == "+":
            if at >= over["phone"] and (m := _PHONE.match(text, at)):
                over["phone"] = m.end()
                if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                    found["phone"].append(m.span())
        elif kind == ":":
            start = at - 2
            while start > over["url"] and text[start - 1] in _SCHEME:
                start -= 1
            if start < at - 2 and text[start].isalpha() and (m := _AUTHORITY.match(text, at + 1)):
                found["url"].append((start, m.end()))
                over["url"] = m.end()
        elif at + 1 >= over[kind] and (m := (_IBAN if kind == "iban" else _ACCOUNT).match(text, at + 1)):
            over[kind] = m.end()
            if kind == "account" or _iban_end(m[1]):
                found[kind].append((m.start(1), m.start(1) + (_iban_end(m[1]) if kind == "iban" else len(m[1]))))
    return [(k, a, b) for k in KINDS for a, b in found[k]]


def _iban_end(value: str) -> int:
    """Length of the longest prefix with 15 to 34 characters and a right checksum, else 0."""
    for end in range(len(value), 14, -1):
        if value[end - 1] != " " and 15 <= len(x := value[:end].replace(" ", "")) <= 34 and _mod97(x):
            return end
    return 0


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data in every text: id and spans (kind, start, end in code points; by kind as listed, then start).

    A row for each row. A null or empty text has no spans. Texts are read whole, whatever their length; repeated rows
    give equal results; other columns are ignored. An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in text_chunks(batch.column(1), CHUNK):
                spans = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(x)] for x in part]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), pa.array(spans, type=_SPANS)], names=[id_col, "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, spans {SPANS}")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
