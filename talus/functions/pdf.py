"""Text of simple PDF files: content streams, plain or deflated, and the strings that their text operators show.

Fonts with an encoding of their own, encrypted files and pictures of text are beyond it: they give what can be read, or
nothing. Bytes have no form in built-in functions that could be inflated, so this is a vectorised UDF.
"""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_STREAM = re.compile(rb"\bstream\r?\n(.*?)\r?\n?endstream", re.S)
#: Bytes before a stream in which its dictionary is looked for.
_HEAD = 1000
_SHOWN = re.compile(rb"(?P<array>\[(?:\\.|\((?:\\.|[^\\()])*\)|[^\]])*\])\s*TJ|(?P<one>\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)\s*(?:Tj|'|\")|(?P<move>T\*|\bT[dDm]\b|\bET\b)", re.S)
_STRING = re.compile(rb"\((?P<text>(?:\\.|[^\\()])*)\)|<(?P<hex>[0-9A-Fa-f\s]*)>|(?P<gap>-?[0-9.]+)", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}
#: Thousandths of the font's size that a negative step must have to stand for a blank.
_BLANK = -180


def _literal(raw: bytes) -> bytes:
    one = lambda m: _ESCAPES.get(m[1]) if m[1] in _ESCAPES else bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1] in (b"\n", b"\r") else m[1]
    return re.sub(rb"\\([0-7]{1,3}|.)", one, raw, flags=re.S)


def _decoded(raw: bytes) -> str:
    if raw.startswith(b"\xfe\xff"):
        return raw[2:].decode("utf-16-be", "ignore")
    return raw.decode("cp1252", "ignore")


def _strings(raw: bytes) -> str:
    out = []
    for m in _STRING.finditer(raw):
        if m["text"] is not None:
            out.append(_decoded(_literal(m["text"])))
        elif m["hex"] is not None:
            digits = re.sub(rb"\s", b"", m["hex"])
            out.append(_decoded(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())))
        elif float(m["gap"] if m["gap"].strip(b"-.") else 0) < _BLANK:
            out.append(" ")
    return "".join(out)


def text_of(body: bytes | None) -> str:
    """The text of a PDF's bytes, white space collapsed; empty for what is no PDF or cannot be read."""
    if not body or b"%PDF-" not in body[:1024]:
        return ""
    out = []
    for stream in _STREAM.finditer(body):
        content, head = stream[1], body[max(0, stream.start() - _HEAD) : stream.start()]
        if b"/FlateDecode" in head[head.rfind(b" obj") + 1 :]:
            try:
                content = zlib.decompressobj().decompress(content)
            except zlib.error:
                continue
        if b"BT" not in content:
            continue
        for m in _SHOWN.finditer(content):
            out.append(" " if m["move"] else _strings(m["array"] or m["one"]))
    return " ".join("".join(out).split())


@F.pandas_udf(StringType())
def pdf_text(body: pd.Series) -> pd.Series:
    """text_of() of a binary column, a batch at a time."""
    return body.map(lambda b: text_of(None if b is None else bytes(b)))
