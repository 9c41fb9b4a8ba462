"""Captured pages of paginated scans as a data source: planned by source and range of pages, batch or stream.

A fetcher leaves <folder>/<source>/<day>/<first>-<last>.jsonl: lines {"page", "url", "fetched_at", "body"} of the pages first
to last, each file moved into place when it is whole. Names alone tell what a file holds, so filters on source, day and page
decide which files are opened, and a task is a run of files of one source of about target_bytes.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..operators.lineage import cut

_FILE = re.compile(r"([0-9]+)-([0-9]+)\.jsonl$")
_FIELDS = ("page", "url", "fetched_at", "body")


@dataclass(frozen=True)
class Captured:
    """A file of pages."""

    source: str
    day: str
    first: int
    last: int
    path: str
    size: int

    @property
    def place(self) -> str:
        """Where the file stands among those of its source: captures go forward in days and pages."""
        return f"{self.day}/{self.first:012d}"


@dataclass
class PageRun(InputPartition):
    files: list[Captured]


class _Files:
    """The files below a folder of any file system that Arrow knows; paths without a scheme are local."""

    def __init__(self, options: dict):
        path = options["path"]
        self.fs, self.root = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        self.root = self.root.rstrip("/")
        self.target = int(options.get("target_bytes", 64 << 20))

    def _entries(self, folder: str) -> list[pafs.FileInfo]:
        return sorted(self.fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)), key=lambda x: x.path)

    def found(self, sources=lambda s: True, days=lambda d: True, pages=lambda a, b: True) -> Iterator[Captured]:
        """Files in the order of source, day and page; folders that are not asked for are not listed."""
        for s in self._entries(self.root):
            if s.type != pafs.FileType.Directory or not sources(s.base_name):
                continue
            for d in self._entries(s.path):
                if d.type != pafs.FileType.Directory or not days(d.base_name):
                    continue
                for f in self._entries(d.path):
                    name = _FILE.fullmatch(f.base_name)
                    if name and pages(int(name[1]), int(name[2])):
                        yield Captured(s.base_name, d.base_name, int(name[1]), int(name[2]), f.path, f.size)

    def runs(self, files: Sequence[Captured]) -> list[PageRun]:
        out, size = [], 0
        for f in files:
            if not out or out[-1].files[-1].source != f.source or size + (f.size or 0) > self.target:
                out.append(PageRun([]))
                size = 0
            out[-1].files.append(f)
            size += f.size or 0
        return out

    def lines(self, run: PageRun) -> Iterator[tuple]:
        """The rows of a run. A line that is no such JSON is a row without page and body, so that nothing vanishes."""
        for f in run.files:
            with self.fs.open_input_stream(f.path) as stream:
                for raw in _lines(stream):
                    try:
                        x = json.loads(raw)
                        yield (f.source, f.day, *(x.get(c) for c in _FIELDS))
                    except (ValueError, AttributeError):
                        yield f.source, f.day, None, f.path, None, None


def _lines(stream) -> Iterator[bytes]:
    rest = b""
    while block := stream.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        yield from filter(None, whole)
    if rest:
        yield rest


class CapturedPages(DataSource):
    """spark.read.format("captured_pages").load(folder), and the same with readStream.

    Filters on source, day (=, in) and page (=, <, <=, >, >=) choose the files, if spark.sql.python.filterPushdown.enabled is
    on; register() turns it on. A stream's offset is the last file of each source; a later start goes on behind it.
    """

    @classmethod
    def name(cls) -> str:
        return "captured_pages"

    def schema(self) -> str:
        return "source string, day string, page long, url string, fetched_at string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = _Files(options)
        self.wanted: dict[str, set] = {}
        self.low, self.high = 0, float("inf")

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            name = getattr(f, "attribute", ())
            column = name[0] if len(name) == 1 else None
            if column in ("source", "day") and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            elif column == "page" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                low = f.value + isinstance(f, GreaterThan) if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)) else self.low
                high = f.value - isinstance(f, LessThan) if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)) else self.high
                self.low, self.high = max(self.low, low), min(self.high, high)
            yield f  # rows are still asked; here only files are chosen

    def partitions(self) -> Sequence[InputPartition]:
        asked = lambda column: lambda x: column not in self.wanted or x in self.wanted[column]
        files = self.files.found(asked("source"), asked("day"), lambda a, b: a <= self.high and b >= self.low)
        return self.files.runs(list(files)) or [PageRun([])]

    def read(self, partition: PageRun) -> Iterator[tuple]:
        yield from self.files.lines(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.files = _Files(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        out: dict[str, str] = {}
        for f in self.files.found():
            out[f.source] = max(out.get(f.source, ""), f.place)
        return out

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        new = [f for f in self.files.found() if start.get(f.source, "") < f.place <= end.get(f.source, "")]
        return self.files.runs(new) or [PageRun([])]

    def read(self, partition: PageRun) -> Iterator[tuple]:
        yield from self.files.lines(partition)

    def commit(self, end: dict) -> None:
        pass


def store(pages: DataFrame, folder: str, per_file: int = 64) -> DataFrame:
    """Write pages (source, day, page, url, fetched_at, body) as the files that captured_pages reads; (source, day, first, last,
    path) of the files once they are written.

    A file takes the pages whose numbers from 1 share a run of per_file, so a task holds that many bodies at most. A file is
    moved into place when it is whole, and written again with the same name where a lost task is repeated.
    """
    fields = ("source", "day", "page", "url", "fetched_at", "body")
    rows = pages.select(*fields).withColumn("_run", F.expr(f"(page - 1) div {per_file}"))

    def write(lines: pa.Table) -> pa.Table:
        fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
        rows = sorted(lines.to_pylist(), key=lambda x: (x["page"], x["url"] or ""))
        at = f"{root.rstrip('/')}/{rows[0]['source']}/{rows[0]['day']}"
        fs.create_dir(at)
        name = f"{rows[0]['page']}-{rows[-1]['page']}.jsonl"
        part = f"{at}/.{name}.{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as out:
            for x in rows:
                out.write((json.dumps({c: x[c] for c in _FIELDS}, ensure_ascii=False) + "\n").encode())
        fs.move(part, f"{at}/{name}")
        return pa.table({"source": [rows[0]["source"]], "day": [rows[0]["day"]], "first": [rows[0]["page"]], "last": [rows[-1]["page"]], "path": [f"{at}/{name}"]})

    files = rows.groupBy("source", "day", "_run").applyInArrow(lambda lines: write(lines), "source string, day string, first long, last long, path string")
    return cut(files)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CapturedPages)


def missing_pages(pages: DataFrame, scan: str, page: str, declared: Column, size: int) -> DataFrame:
    """(scan, page): the pages that a scan's declared total asks for and that were not captured.

    A scan of n records in pages of size has ceil(n / size) of them; its largest declared total counts. A scan that declares
    none lacks none.
    """
    totals = pages.groupBy(scan).agg(F.max(declared.cast("long")).alias("_n")).where("_n > 0")
    asked = totals.select(scan, F.explode(F.sequence(F.lit(1).cast("long"), F.expr(f"(_n + {size} - 1) div {size}"))).alias(page))
    return asked.join(pages.select(scan, F.col(page).cast("long").alias(page)).distinct(), [scan, page], "left_anti")
