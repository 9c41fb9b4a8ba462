"""Seen history over a stream: each micro-batch adds a run, and runs are merged level by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SeenHistory:
    """first_seen, last_seen and times_seen of each key, in numbered runs below a folder.

    A batch writes what it alone has seen; every fan-th one merges the runs of its level into one of the next, so a key
    is rewritten once a level, not once a batch, and at most fan - 1 runs a level are read. Which runs make up the state
    follows from the number of batches alone. A batch reads runs that earlier ones completed and overwrites none but its
    own, so it can be run again after a failure. Batches without rows count as runs without rows; null keys are a key.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, ts: str, fan: int = 8):
        if fan < 2:
            raise ValueError("fan must be 2 at least")
        self.spark, self.folder, self.key, self.ts, self.fan = spark, folder.rstrip("/"), key, ts, fan

    def runs(self, batches: int) -> list[int]:
        """Numbers of the runs that make up the state after so many batches: a run is named by the last batch it holds."""
        out, width = [], 1
        while width <= batches:
            above = batches - batches % (width * self.fan)
            out += range(above + width, batches + 1, width)
            batches, width = above, width * self.fan
        return out

    def _merged(self, parts: list[DataFrame]) -> DataFrame:
        rows = reduce(DataFrame.unionByName, parts)
        return rows.groupBy(self.key).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("times_seen").alias("times_seen"))

    def _run(self, end: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/v={end}")

    def version(self, n: int) -> DataFrame:
        """The state after batch n, counted from 0."""
        return self._merged([self._run(x) for x in self.runs(n + 1)])

    def batch(self, rows: DataFrame, n: int) -> None:
        new = rows.groupBy(self.key).agg(F.min(self.ts).alias("first_seen"), F.max(self.ts).alias("last_seen"), F.count("*").alias("times_seen"))
        before = sorted(set(self.runs(n)) - set(self.runs(n + 1)))
        if before:
            new = self._merged([new, *(self._run(x) for x in before)])
        new.write.mode("overwrite").parquet(f"{self.folder}/v={n + 1}")

    def _folders(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/v=*/_SUCCESS")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs, {int(x.getPath().getParent().getName()[2:]): x.getPath().getParent() for x in fs.globStatus(path) or ()}

    def prune(self) -> None:
        """Delete the runs that neither the newest state nor the one before it needs."""
        fs, folders = self._folders()
        newest = max(folders, default=0)
        for end in folders.keys() - set(self.runs(newest)) - set(self.runs(newest - 1)):
            fs.delete(folders[end], True)

    def run(self, stream: DataFrame, checkpoint: str) -> DataFrame:
        """Take in all that the stream has now; the state after it. Without anything new it is the state of the last run.

        A stream that never had a batch gives a table without rows.
        """
        query = stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        newest = max(self._folders()[1], default=0)
        if newest:
            return self.version(newest - 1)
        types = dict(stream.dtypes)
        return self.spark.createDataFrame([], f"`{self.key}` {types[self.key]}, first_seen {types[self.ts]}, last_seen {types[self.ts]}, times_seen long")


def windowed_counts(stream: DataFrame, ts: str, by: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts in tumbling windows, with a watermark for late rows."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"))
