"""The archive of runs: state and report under one manifest, a pointer to the latest, and an audit of a range of days."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import Folder

REQUIRED = ("canonical", "sources")


class RunArchive:
    """runs/<day>/<run_id>/<table> below a folder, and runs/<day>/<run_id>/manifest.json once all of them are there.

    A run without its manifest does not exist for any reader, so a publisher that dies leaves nothing half done; a run that is
    there is never replaced. latest.json names the newest day's run that was published last.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.files = Folder(spark, folder)

    def publish(self, day: str, run_id: str, tables: Mapping[str, DataFrame], state_rows: int, reported: int | None, required: Sequence[str] = REQUIRED) -> dict:
        """Write a run's tables and commit them with the state that they tell of; the manifest.

        reported: how many rows of state the run's own summary names. A run whose state was off (None), of whose numbers one
        differs from the other, or in which a required table is absent or empty, is refused, and its files go.
        """
        date.fromisoformat(day)
        name = re.sub(r"[^A-Za-z0-9_-]", "", run_id)
        if not name:
            raise ValueError(f"no letters in the run's name {run_id!r}")
        if reported is None:
            raise ValueError("a run without state is not published")
        if reported != state_rows:
            raise ValueError(f"the report tells of {reported} rows of state, and {state_rows} are there")
        at = f"runs/{day}/{name}"
        if "manifest.json" in self.files.names(at):
            raise FileExistsError(at)
        rows = {}
        for table, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.folder}/{at}/{table}")
            rows[table] = self.spark.read.schema(df.schema).parquet(f"{self.folder}/{at}/{table}").count()
        lacking = [t for t in required if not rows.get(t)]
        if lacking:
            self.files.delete(at)
            raise ValueError(f"no rows in {', '.join(lacking)}")
        manifest = {"day": day, "run_id": name, "prefix": at, "rows": rows, "state_rows": state_rows, "schemas": {t: df.schema.simpleString() for t, df in tables.items()}}
        self.files.commit(f"{at}/manifest.json", manifest)
        newest = self.latest()
        if newest is None or newest["day"] <= day:
            self.files.point("latest.json", manifest)
        return manifest

    def latest(self) -> dict | None:
        return self.files.read("latest.json") if "latest.json" in self.files.names() else None

    def table(self, run: dict, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{run['prefix']}/{name}")

    def usable(self, day: str, required: Sequence[str] = REQUIRED) -> tuple[dict | None, list[str]]:
        """(manifest, errors): of a day's runs the one of the greatest name whose manifest and required tables are sound, and
        what is wrong with those of greater names."""
        errors = []
        for run in sorted(self.files.names(f"runs/{day}"), reverse=True):
            at = f"runs/{day}/{run}"
            try:
                found = self.files.read(f"{at}/manifest.json")
                if found.get("day") != day:
                    raise ValueError("the manifest is of another day")
                for t in required:
                    if not found.get("rows", {}).get(t):
                        raise ValueError(f"{t} has no rows")
                    counted = self.table(found, t).count()
                    if counted != found["rows"][t]:
                        raise ValueError(f"{t} has {counted} rows instead of {found['rows'][t]}")
                return found, errors
            except Exception as e:  # whatever is wrong with a run is what the audit tells
                errors.append(f"{run}: {type(e).__name__}: {str(e).splitlines()[0]}")
        return None, errors

    def audit(self, last: str, days: int, required: Sequence[str] = REQUIRED) -> DataFrame:
        """A row for each of so many days up to the last: day, run_id, rows by table, ok, error (why there is no run), ignored
        (what is wrong with newer runs). The period is complete if all rows are ok."""
        end, out = date.fromisoformat(last), []
        for n in reversed(range(days)):
            day = (end - timedelta(days=n)).isoformat()
            found, errors = self.usable(day, required)
            error = "" if found else f"no usable run ({'; '.join(errors)})" if errors else "no run was published"
            out.append((day, found["run_id"] if found else None, {k: int(v) for k, v in found["rows"].items()} if found else {}, found is not None, error, errors if found else []))
        return self.spark.createDataFrame(out, "day string, run_id string, rows map<string, long>, ok boolean, error string, ignored array<string>")

    def read(self, audited: DataFrame, name: str) -> DataFrame:
        """The table of all days that an audit found usable, with the day that each row is of."""
        paths = {r["day"]: f"{self.folder}/runs/{r['day']}/{r['run_id']}/{name}" for r in audited.where("ok").select("day", "run_id").collect()}
        parts = [self.spark.read.parquet(p).withColumn("archive_day", F.lit(d)) for d, p in sorted(paths.items())]
        if not parts:
            raise ValueError("no day has a usable run")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out
