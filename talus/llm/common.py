"""What the operators of this subpackage share: reading, staging and batching."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one that the cluster names in spark.checkpoint.dir.

    Only where that setting is absent and all runs on one machine (tests) a temporary folder takes its place; on a cluster
    its absence is an error, since executors would each write to a folder of their own.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="talus-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it again.

    An executor that is lost later costs only the reread of its splits.
    """
    spark = df.sparkSession
    out = shared_dir(spark, name)
    df.write.option("compression", compression).parquet(out)
    return spark.read.schema(df.schema).parquet(out)


def release() -> None:
    """Give the memory that this worker has freed back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, followed by release().

    A worker outlives its tasks: without this it would hold, in all later stages, the most that any task before has taken.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def texts(column: pa.Array) -> list[str]:
    """A null text counts as an empty one."""
    return [x or "" for x in column.to_pylist()]


def _runs(sizes: list[int], limit: int, rows: int) -> Iterator[tuple[int, int]]:
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if i > first and (total + n > limit or i - first == rows):
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def chunks(items: list[str], limit: int) -> Iterator[tuple[int, list[str]]]:
    """(offset, texts) of consecutive runs of at most limit characters; a longer text is a run of its own."""
    for a, b in _runs(list(map(len, items)), limit, len(items)):
        yield a, items[a:b]


def text_chunks(column: pa.Array, limit: int) -> Iterator[tuple[int, list[str]]]:
    """(offset, texts) of runs of rows of at most limit bytes; only one run at a time is held as Python objects."""
    for a, b in _runs(_sizes(column), limit, 4000):
        yield a, texts(column.slice(a, b - a))


def byte_chunks(column: pa.Array, limit: int) -> Iterator[tuple[int, list[bytes]]]:
    """text_chunks() in UTF-8, A-Z in lower case."""
    column = column.cast(pa.binary())
    for a, b in _runs(_sizes(column), limit, 4000):
        yield a, [(x or b"").lower() for x in column.slice(a, b - a).to_pylist()]


def _sizes(column: pa.Array) -> list[int]:
    return pc.fill_null(pc.binary_length(column), 0).to_pylist()
