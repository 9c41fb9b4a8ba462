"""The state machine of seen records on a stream: NEW, SEEN, MATERIALLY_CHANGED, REOPENED, one key's state at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.state import OPEN

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = T.StructType([T.StructField("first_us", T.LongType()), T.StructField("last_us", T.LongType()), T.StructField("times", T.IntegerType()), T.StructField("fields", T.ArrayType(T.StringType()))])


class _Lifecycle(StatefulProcessor):
    def __init__(self, fields: Sequence[str], status: str, ttl_ms: int | None):
        self.fields, self.at_status, self.ttl_ms = list(fields), list(fields).index(status), ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("record", _STATE, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        """In the order of time, then of place; ties by the row's fields, so the order within a batch does not matter."""
        seen = []
        for x in rows:
            seen.append((x["us"], x["place"], [x[f"f{i}"] for i in range(len(self.fields))]))
        seen.sort(key=lambda r: (r[0], r[1], [x or "" for x in r[2]]))
        held = self.state.get() if self.state.exists() else None
        first, last, times, old = (held[0], held[1], held[2], list(held[3])) if held is not None else (None, None, 0, None)
        out = []
        for us, place, new in seen:
            changed: list[str] = []
            if last is not None and us < last:
                told = "LATE"
            elif old is None:
                told, first = "NEW", us
            else:
                changed = [c for c, a, b in zip(self.fields, old, new, strict=True) if a != b]
                reopened = old[self.at_status] == "CLOSED" and new[self.at_status] in OPEN
                told = "REOPENED" if reopened else "MATERIALLY_CHANGED" if changed else "SEEN"
            times += 1
            if told != "LATE":
                last, old = us, new
            first = min(first, us)
            out.append(Row(key=key[0], us=us, place=place, seen_status=told, change_reasons=changed, times_seen=times, first_us=first))
        self.state.update((first, last, times, old))
        yield from out

    def close(self) -> None:
        pass


def lifecycle(rows: DataFrame, key: str, ts: str, place: str, fields: Sequence[str], status: str, ttl_days: float | None = None) -> DataFrame:
    """(key, ts, place, seen_status, change_reasons, times_seen, first_seen) for every row of a stream.

    status is one of fields; fields are compared as strings, null is a value. Rows of a key are taken in the order of ts,
    then place (a whole number). A row that is older than the key's last one is LATE: it counts in times_seen and first_seen
    and changes nothing else. A record that was CLOSED and is open again is REOPENED; change_reasons names the fields that
    differ. ttl_days: a key that was not seen for so long is forgotten, and NEW when it comes again. Rows without a time are
    left out; a null key is a key. State is kept by Spark's state store, in tasks dealt by the key.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    named = rows.where(F.col(ts).isNotNull()).select(F.col(key).cast("string").alias("key"), us.alias("us"), F.col(place).cast("long").alias("place"), *(F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(fields)))
    kind = "key string, us long, place long, seen_status string, change_reasons array<string>, times_seen int, first_us long"
    machine = _Lifecycle(fields, status, None if ttl_days is None else int(ttl_days * 86_400_000))
    out = named.groupBy("key").transformWithState(machine, kind, "append", "none")
    return out.select(F.col("key").cast(rows.schema[key].dataType).alias(key), F.timestamp_micros("us").alias(ts), F.col("place").alias(place), "seen_status", "change_reasons", "times_seen", F.timestamp_micros("first_us").alias("first_seen"))


def run(spark: SparkSession, stream: DataFrame, folder: str) -> DataFrame:
    """Take in all that the stream has now, behind what earlier runs with this folder took; all that came out so far.

    Between its batches a task lets go of its part of the state, and commits what changed in it: a run that takes in what is
    there and ends would otherwise leave an open database for each part on its executors' disks.
    """
    spark.conf.set("spark.sql.streaming.stateStore.unloadOnCommit", "true")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
