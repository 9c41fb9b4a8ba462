"""The persistent state below a folder: versions that are committed whole, each at the cost of what it changes."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import BucketedTable
from .commits import Folder
from .state import checked

STATE = "state_id string, aliases array<string>, first_seen string, last_seen string, times_seen int"


class StateStore:
    """Versions 1, 2, ... of a state table, each of a layout: a bucketed table for each layout, by state_id.

    save() commits the next version. With the day that the state was advanced to, only the rows that were seen on it are
    written, since the others are as they were. A version counts once its manifest is there, so a run that dies leaves the one
    before it, and a second writer that has read the same version gets a Conflict instead of taking its place. upgrades turn
    an older layout into the next one when it is loaded; the first save in a new layout writes the whole state.
    """

    def __init__(self, spark: SparkSession, folder: str, snapshot: str, layout: int, upgrades: Mapping[int, Callable[[DataFrame], DataFrame]] | None = None, buckets: int = 64):
        self.spark, self.folder, self.layout, self.upgrades, self.buckets = spark, folder.rstrip("/"), layout, dict(upgrades or {}), buckets
        self.schema = f"{STATE}, last_snapshot {snapshot}"

    def _table(self, layout: int, start: int = 0, schema: str | None = None) -> BucketedTable:
        return BucketedTable(self.spark, f"{self.folder}/layout={layout}", ["state_id"], schema or self.schema, self.buckets, start=start)

    def versions(self) -> list[tuple[int, int]]:
        """(version, layout) of the committed versions, in order."""
        layouts = [int(n.split("=")[1]) for n in Folder(self.spark, self.folder).names() if n.startswith("layout=")]
        return sorted((v, layout) for layout in layouts for v in self._table(layout).versions())

    def load(self) -> DataFrame:
        """The latest version in the present layout; an empty state if there is none. A layout that no upgrade leads from,
        or columns that are not a state's, are an error, never an empty history."""
        found = self.versions()
        if not found:
            return self.spark.createDataFrame([], self.schema)
        version, layout = found[-1]
        state = self.load_version(version, layout)
        while layout != self.layout:
            if layout not in self.upgrades:
                raise ValueError(f"unknown state layout {layout}")
            state, layout = self.upgrades[layout](state), layout + 1
        return checked(state, layout, [self.layout])

    def save(self, state: DataFrame, day: str | None = None, base: int | None = None) -> int:
        """Commit the next version and return its number. An empty state after one with rows is refused.

        base: the version that the state was made from (the latest one). Without day, rows that the state lacks go.
        """
        found = self.versions()
        version, layout = found[-1] if found else (0, self.layout)
        whole = layout != self.layout
        earlier = [v for v, of in found if of != self.layout]
        table = self._table(self.layout, version if whole else max(earlier, default=0))
        if whole or day is None:
            before = self.load() if found else None
            if before is not None and state.isEmpty() and not before.isEmpty():
                raise ValueError("an empty state would replace one with rows")
            changes = state.withColumn("_out", F.lit(False))
            if before is not None and not whole:
                lost = before.join(state.select("state_id"), "state_id", "left_anti").withColumn("_out", F.lit(True))
                changes = changes.unionByName(lost)
            return table.upsert(changes, F.col("_out"), base=version if base is None else base)
        return table.upsert(state.where(F.col("last_seen") == day), base=version if base is None else base)

    def load_version(self, version: int, layout: int) -> DataFrame:
        # an older layout has columns of its own
        return self._table(layout, schema=self._table(layout).manifest(version)["schema"]).load(version)

    def prune(self, keep: int) -> None:
        """Delete all but the latest versions."""
        kept = self.versions()[-max(1, keep) :]
        for layout in {of for _, of in self.versions()}:
            own = [v for v, of in kept if of == layout]
            if own:
                self._table(layout).vacuum(len(own))
            else:
                Folder(self.spark, self.folder).delete(f"layout={layout}")


def newest(states: Sequence[tuple[str, DataFrame]], day: str = "last_seen") -> tuple[str, DataFrame] | None:
    """Of several older states that may be migrated the one whose records were seen last, the first on a tie; None of none."""
    dated = [(df.agg(F.max(day)).first()[0], -i, name, df) for i, (name, df) in enumerate(states)]
    dated = [d for d in dated if d[0] is not None]
    if not dated:
        return None
    _, _, name, df = max(dated, key=lambda d: d[:2])
    return name, df
