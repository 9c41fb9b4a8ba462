"""A keyed table that takes changes at their own cost: hash buckets with runs, and a manifest for each version."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .commits import Conflict, Folder

_RUN, _GONE, _BUCKET = "_run", "_gone", "_bucket"


class BucketedTable:
    """Rows by key below a folder. Version n is the file commits/n.json: for each bucket the runs that make it up, in order.

    upsert() writes the changed rows only, as one run, and commits the next version; a run that dies before leaves files
    that no version names. A bucket that has gathered fan runs is written anew in the same commit, so a row is rewritten
    once for fan changes of its bucket, and a read takes at most fan runs of it. The manifest has a line for each bucket,
    whatever the rows. Of a key the row of the latest run counts. Versions stay readable until vacuum().

    Key columns must be orderable; null is a key like others. buckets are fixed when the table is made. Versions count from
    start, that of the empty table.
    """

    def __init__(self, spark: SparkSession, folder: str, key: Sequence[str], schema: str, buckets: int = 64, fan: int = 8, start: int = 0):
        self.spark, self.folder, self.key, self.schema, self.n, self.fan, self.start = spark, folder.rstrip("/"), list(key), schema, buckets, fan, start
        self.files = Folder(spark, folder)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.n)).cast("int")

    def version(self) -> int:
        """The latest version; start before the first."""
        return max(self.versions(), default=self.start)

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.files.names("commits") if n.endswith(".json"))

    def manifest(self, version: int) -> dict:
        if version == self.start:
            return {"version": version, "buckets": {}}
        found = self.files.read(f"commits/{version}.json")
        if (found["key"], found["n"]) != (self.key, self.n):
            raise ValueError(f"the table has the key {found['key']} and {found['n']} buckets")
        return found

    def _runs(self, buckets: dict[str, list[str]], rules: Column | None = None) -> DataFrame:
        """All rows of the runs of these buckets, with the place of a row's run in its bucket."""
        by_run: dict[str, list[tuple[int, int]]] = {}
        for b, runs in buckets.items():
            for at, run in enumerate(runs):
                by_run.setdefault(run, []).append((int(b), at))
        parts = []
        for run, places in by_run.items():
            rows = self.spark.read.schema(f"{self.schema}, {_GONE} boolean, {_BUCKET} int").parquet(f"{self.folder}/data/{run}").where(F.col(_BUCKET).isin([b for b, _ in places]))
            order = F.create_map(*(F.lit(x) for p in places for x in p))
            parts.append(rows.withColumn(_RUN, F.try_element_at(order, F.col(_BUCKET))))
        empty = self.spark.createDataFrame([], f"{self.schema}, {_GONE} boolean, {_BUCKET} int, {_RUN} int")
        return reduce(DataFrame.unionByName, parts, empty)

    def _latest(self, rows: DataFrame) -> DataFrame:
        # only buckets of several runs have keys of several rows; one key has at most as many rows as runs
        last = Window.partitionBy(_BUCKET, *self.key).orderBy(F.desc(_RUN))
        return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", _RUN)

    def load(self, version: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """The rows of a version (the latest one); with keys, those of their keys, of whose buckets alone files are read."""
        found = self.manifest(self.version() if version is None else version)
        buckets = found["buckets"]
        if keys is not None:
            asked = {str(r[0]) for r in keys.select(self._bucket()).distinct().collect()}  # as many as there are buckets at most
            buckets = {b: runs for b, runs in buckets.items() if b in asked}
        rows = self._latest(self._runs(buckets)).where(f"NOT {_GONE}").drop(_GONE, _BUCKET)
        if keys is None:
            return rows
        met = reduce(lambda a, b: a & b, (F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in self.key))
        return rows.alias("x").join(keys.select(*self.key).alias("y"), met, "left_semi")

    def _write(self, rows: DataFrame) -> tuple[str, list[str]]:
        run = uuid.uuid4().hex
        path = f"{self.folder}/data/{run}"
        rows.repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(path)
        return run, [n.split("=")[1] for n in self.files.names(f"data/{run}") if n.startswith(_BUCKET)]

    def upsert(self, changes: DataFrame, gone: Column | None = None, base: int | None = None, tries: int = 5) -> int:
        """Put rows in the place of those of their keys, or take keys out where gone holds; the new version.

        Of several changes of one key one stays, which one is not said: fold them before. With base, the version that the
        changes were made from, Conflict is raised if another writer has committed since; without it the changes go on top of
        whatever is there.
        """
        flagged = changes.withColumn(_GONE, F.coalesce(F.lit(False) if gone is None else gone, F.lit(False))).withColumn(_BUCKET, self._bucket())
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        run, touched = self._write(flagged.dropDuplicates(self.key).select(*names, _GONE, _BUCKET))
        for _ in range(tries):
            at = self.version() if base is None else base
            if self.version() != at:
                raise Conflict(f"version {self.version()} was committed since {at}")
            found = self.manifest(at)
            buckets = {b: list(runs) for b, runs in found["buckets"].items()}
            for b in touched:
                buckets.setdefault(b, []).append(run)
            full = {b: runs for b, runs in buckets.items() if len(runs) > self.fan}
            if full:
                whole, there = self._write(self._latest(self._runs(full)).where(f"NOT {_GONE}").select(*names, _GONE, _BUCKET))
                for b in full:
                    buckets[b] = [whole] if b in there else []
            try:
                self.files.commit(f"commits/{at + 1}.json", {"version": at + 1, "key": self.key, "n": self.n, "schema": self.schema, "buckets": buckets})
                return at + 1
            except Conflict:
                if base is not None:
                    raise
        raise Conflict(f"{tries} other writers were faster")

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete all but the latest versions, and runs that none of these names. No writer may be at work."""
        newest = self.version()
        kept = [self.manifest(v) for v in self.versions()[-keep:]]
        named = {run for m in kept for runs in m["buckets"].values() for run in runs}
        for n in self.files.names("commits"):
            if n.endswith(".json") and int(n.removesuffix(".json")) <= newest - keep:
                self.files.delete(f"commits/{n}")
        old = [r for r in self.files.names("data") if r not in named]
        for r in old:
            self.files.delete(f"data/{r}")
        return old
