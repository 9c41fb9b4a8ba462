"""WARC archives with revisit records, and a two-level capture index over them.

Writing: payloads are grouped by digest; the record of the least page id is a response, the others are revisits that name
it. Each task writes one archive of gzip members and hands on where each record lies.

Index: captures are range-partitioned and sorted by reversed-host URL key. Each task writes a shard of compressed blocks
of LINES lines, and beside it the shard's sparse directory (first key, offset and length of each block). The top level is
the first key of each shard. A lookup bisects the top level, the shard's directory and the block, then reads the record's
bytes: three small range reads, whatever the size of the archives.

Files go to the shared folder by way of pyarrow's file systems, under names of their own for each attempt; only files of
attempts that succeeded are named in the tables, so a task that runs again leaves nothing half-written in the index.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stage

#: Lines of a block; captures of an index shard and of a lookup task, which also ends at so many bytes of records.
LINES, SHARD, READ = 2000, 500_000, 32_000_000
LEVEL = 5
OPEN_FILES = 16


def surt(url: str | None) -> str:
    """Key of a URL by reversed host: https://m.example.com:8080/a?b -> com,example,m:8080)/a?b. Fragments go.

    What is no URL, null and empty included, is its own key with nothing reversed.
    """
    clean = quote(url or "", safe="!#$%&'()*+,/:;=?@[]~-._")
    try:
        parts = urlsplit(clean)
        host, port = parts.hostname, parts.port
    except ValueError:
        return clean
    if not host:
        return clean
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def capture_key(url: str | None, page_id: int | None) -> str:
    """Sorts by URL, then by page id; a null id comes first."""
    return f"{surt(url)} {'-' if page_id is None else f'{page_id + (1 << 63):020d}'}"


def _record(page_id, url, payload: bytes, digest: str, refers_to, date: str, response: bool) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if response else head
    lines = ["WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {quote(url or '', safe='!#$%&()*+,/:;=?@[]~-._')}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if not response:
        lines[3:3] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(member: bytes) -> dict:
    """page_id, type, refers_to, payload (None for a revisit), payload_bytes and payload_digest of a gzip member.

    The payload of a response is measured and digested anew; a revisit gives what its headers say.
    """
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda x: None if x == "None" else int(x)
    out = {"page_id": number(fields["WARC-Record-ID"][10:-1]), "type": fields["WARC-Type"], "refers_to": None, "payload": payload}
    if out["type"] == "revisit":
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        return out | {"refers_to": number(fields["WARC-Refers-To"][10:-1]), "payload": None, "payload_bytes": size, "payload_digest": fields["WARC-Payload-Digest"][5:]}
    return out | {"payload_bytes": len(payload), "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode()}


def write(pages: DataFrame, folder: str, min_payload: int = 0, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a record for each row and return (key, page_id, file, offset, length), staged.

    Ids are whole numbers. A null payload is empty; payloads of any length are written whole. Of equal payloads of min_payload bytes or more, rows with the least id are responses, the
    others revisits; smaller payloads are all responses. A null id is greater than any other. Repeated rows with the least
    id are responses each. Other columns are ignored; an empty table writes no records.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    least = rows.where(F.octet_length("payload") >= min_payload).groupBy("digest").agg(F.min("page_id").alias("first_id"))
    rows = rows.join(least, "digest", "left").withColumn("response", (F.octet_length("payload") < min_payload) | F.col("page_id").eqNullSafe(F.col("first_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            if out is None:
                store, path = fs.FileSystem.from_uri(folder)
                store.create_dir(path, recursive=True)
                name = f"{path}/{uuid.uuid4().hex}.warc.gz"
                out, at = store.open_output_stream(name, compression=None), 0
            found = []
            for x in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "first_id", "response")), strict=True):
                page_id, url, payload, digest, first_id, response = x
                squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = squeeze.compress(_record(page_id, url, payload, base64.b32encode(bytes.fromhex(digest)).decode(), first_id, date, response)) + squeeze.flush()
                out.write(member)
                found.append((capture_key(url, page_id), page_id, name, at, len(member)))
                at += len(member)
            if found:
                out.flush()
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    return stage(rows.mapInArrow(run, "key string, page_id long, file string, offset long, length long"), "warc-captures")


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Write the index's shards and directories; return the top level (first_key, shard), a row for each shard.

    A shard holds about SHARD captures. Repeated keys stay, one line each. An empty table gives an index without shards, in
    which nothing is found.
    """
    shards = max(1, -(-captures.count() // SHARD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: list[str] = []
        keys: list[str] = []
        directory: list[str] = []
        out = None
        for batch in batches:
            if batch.num_rows and out is None:
                store, path = fs.FileSystem.from_uri(folder)
                store.create_dir(path, recursive=True)
                name = f"{path}/{uuid.uuid4().hex}.idx"
                out, at = store.open_output_stream(name, compression=None), 0
            for key, file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("key", "file", "offset", "length")), strict=True):
                keys.append(key), lines.append(f"{key}\t{file}\t{offset}\t{length}")
                if len(lines) == LINES:
                    at += _block(out, directory, keys, lines, at)
        if out is not None:
            if lines:
                _block(out, directory, keys, lines, at)
            out.close()
            with store.open_output_stream(f"{name}.dir", compression=None) as d:
                d.write("\n".join(directory).encode())
            yield pa.RecordBatch.from_arrays([pa.array([directory[0].split("\t")[0]]), pa.array([name])], names=["first_key", "shard"])

    return stage(captures.select("key", "file", "offset", "length").repartitionByRange(shards, "key").sortWithinPartitions("key").mapInArrow(run, "first_key string, shard string"), "warc-top")


def _block(out, directory: list[str], keys: list[str], lines: list[str], at: int) -> int:
    data = zlib.compress("\n".join(lines).encode(), LEVEL)
    out.write(data)
    directory.append(f"{keys[0]}\t{at}\t{len(data)}")
    keys.clear(), lines.clear()
    return len(data)


class Reader:
    """Lookups of capture keys in an index; keeps a few open files, one shard's directory and one block."""

    def __init__(self, folder: str, top: list[tuple[str, str]]):
        self.store, _ = fs.FileSystem.from_uri(folder)
        self.firsts, self.shards = [k.encode() for k, _ in top], [s for _, s in top]
        self.files: OrderedDict[str, pa.NativeFile] = OrderedDict()
        self.directory: tuple[str, list, list] = ("", [], [])
        self.block: tuple[tuple, list] = ((), [])

    def _range(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.files:
            if len(self.files) >= OPEN_FILES:
                self.files.popitem(last=False)[1].close()
            self.files[name] = self.store.open_input_file(name)
        self.files.move_to_end(name)
        return self.files[name].read_at(length, offset)

    def lookup(self, key: str) -> Iterator[dict]:
        """The captures with this key."""
        want = key.encode()
        # Equal keys may begin in the block, or the shard, before the one that starts with the key.
        shard = max(0, bisect.bisect_left(self.firsts, want) - 1)
        while shard < len(self.shards) and self.firsts[shard] <= want:
            name = self.shards[shard]
            if self.directory[0] != name:
                with self.store.open_input_stream(f"{name}.dir", compression=None) as d:
                    rows = [x.split("\t") for x in d.read().decode().split("\n")]
                self.directory = (name, [r[0].encode() for r in rows], [(int(r[1]), int(r[2])) for r in rows])
            _, firsts, blocks = self.directory
            b = max(0, bisect.bisect_left(firsts, want) - 1)
            while b < len(blocks) and firsts[b] <= want:
                if self.block[0] != (name, b):
                    lines = [x.split("\t") for x in zlib.decompress(self._range(name, *blocks[b])).decode().split("\n")]
                    self.block = ((name, b), [(x[0].encode(), *x[1:]) for x in lines])
                lines = self.block[1]
                i = bisect.bisect_left(lines, (want,))
                while i < len(lines) and lines[i][0] == want:
                    _, file, offset, length = lines[i]
                    yield parse(self._range(file, int(offset), int(length)))
                    i += 1
                b += 1
            shard += 1


def lookup(keys: DataFrame, top: DataFrame, folder: str, tasks: int, key_col: str = "key") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and payload of each capture whose key is asked for.

    The keys are sorted over the cluster like the index, so that a task reads its blocks one after the other; tasks is into
    how many ranges, since a key is small whatever its record is (reading_tasks()). A key asked for more than once, null
    included, counts once; unknown keys give no row, and no keys an empty result. The top level that each task gets has a
    row for each shard.
    """
    shared = keys.sparkSession.sparkContext.broadcast(sorted(((r[0], r[1]) for r in top.collect()), key=lambda r: r[0].encode()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder, shared.value)
        for batch in batches:
            names = ("page_id", "payload_bytes", "payload_digest", "type", "refers_to", "payload")
            found = [tuple(r[c] for c in names) for key in batch.column(0).to_pylist() for r in reader.lookup(key)]
            if found:
                columns = [pa.array(c, type=t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    wanted = keys.select(F.col(key_col).alias("key")).distinct().repartitionByRange(tasks, "key").sortWithinPartitions("key")
    return wanted.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def capture_keys(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The capture key of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([capture_key(u, i) for i, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], type=pa.string())], names=["key"])

    return pages.select(F.col(id_col).cast("long"), url_col).mapInArrow(run, "key string")


def reading_tasks(captures: DataFrame) -> int:
    """Into how many tasks a lookup of all captures is to be cut: READ bytes of compressed records each."""
    return max(1, -(-(captures.agg(F.sum("length")).first()[0] or 0) // READ))


def archive(spark: SparkSession, pages: DataFrame, **columns: str) -> tuple[str, DataFrame, DataFrame]:
    """Write pages and their index to a fresh shared folder: the folder, the index's top level and the captures."""
    folder = shared_dir(spark, "warc")
    captures = write(pages, folder, **columns)
    return folder, build_index(captures, folder), captures
