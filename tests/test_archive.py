"""Bucketed tables and the archive of runs: what is written, what a dead or second writer leaves, what an audit says."""

import os
import random

import pytest
from pyspark.sql import functions as F

from talus.operators.archive import RunArchive
from talus.operators.buckets import BucketedTable
from talus.operators.commits import Conflict, Folder

SCHEMA = "k long, v string"


def rows(spark, pairs):
    return spark.createDataFrame(pairs, SCHEMA)


def state(table, version=None):
    return {r["k"]: r["v"] for r in table.load(version).collect()}


def size(folder):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_versions_are_what_a_dict_would_be(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path), ["k"], SCHEMA, buckets=4, fan=3)
    assert state(table) == {} and table.version() == 0
    r, plain, want = random.Random(3), {}, [{}]
    for n in range(8):
        change = {r.choice([None, *range(30)]): r.choice(["", None, f"v{n}"]) for _ in range(7)}
        gone = {k for k in change if k is not None and r.random() < 0.3}
        assert table.upsert(rows(spark, list(change.items())), F.col("k").isin(list(gone))) == n + 1
        plain = {k: v for k, v in {**plain, **change}.items() if k not in gone}
        want.append(dict(plain))
        assert max(map(len, table.manifest(n + 1)["buckets"].values())) <= 3
    assert [state(table, v) for v in range(9)] == want
    some = {r["k"] for r in table.load(keys=rows(spark, [(1, ""), (None, ""), (99, "")])).collect()}
    assert some == {k for k in (1, None) if k in plain}
    assert table.vacuum(2) and state(table) == plain and state(table, 7) == want[7]
    with pytest.raises(FileNotFoundError):
        table.load(3)


def test_a_change_costs_what_it_changes(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path), ["k"], SCHEMA, buckets=16)
    many = spark.range(40_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    table.upsert(many)
    whole = size(tmp_path)
    table.upsert(many.where("k % 100 = 0").withColumn("v", F.sha2(F.concat("v", F.lit("x")), 256)))
    assert size(tmp_path) - whole < 0.05 * whole
    assert table.load().count() == 40_000
    # files of other buckets are not opened: they are spoilt
    mine = many.where("k = 7").select(table._bucket()).first()[0]
    for d, _, names in os.walk(tmp_path):
        for f in names:
            if f.endswith(".parquet") and f"_bucket={mine}/" not in f"{d}/":
                open(f"{d}/{f}", "wb").write(b"spoilt")
    assert table.load(keys=many.where("k = 7")).count() == 1


def test_a_dead_writer_leaves_the_last_version_and_a_second_one_loses_nothing(spark, tmp_path, monkeypatch):
    table = BucketedTable(spark, str(tmp_path), ["k"], SCHEMA, buckets=2)
    table.upsert(rows(spark, [(1, "a")]))
    with monkeypatch.context() as m:
        m.setattr(Folder, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("dead")))
        with pytest.raises(RuntimeError):
            table.upsert(rows(spark, [(1, "lost")]))
    assert state(table) == {1: "a"}
    # another writer commits between this one's look at the version and its own commit
    first = Folder.commit

    def slow(self, name, content, done=[]):  # noqa: B006
        if not done:
            done.append(1)
            BucketedTable(spark, str(tmp_path), ["k"], SCHEMA, buckets=2).upsert(rows(spark, [(2, "other")]))
        first(self, name, content)

    monkeypatch.setattr(Folder, "commit", slow)
    assert table.upsert(rows(spark, [(3, "mine")])) == 3
    assert state(table) == {1: "a", 2: "other", 3: "mine"}
    with pytest.raises(Conflict):
        table.upsert(rows(spark, [(4, "late")]), base=2)
    with pytest.raises(ValueError):
        BucketedTable(spark, str(tmp_path), ["k"], SCHEMA, buckets=3).load()


def test_runs_are_published_whole_or_not_at_all(spark, tmp_path):
    archive = RunArchive(spark, str(tmp_path))
    one = {"canonical": rows(spark, [(1, "a")]), "sources": rows(spark, [(1, "s")])}
    with pytest.raises(ValueError, match="tells of 2"):
        archive.publish("2026-01-01", "r1", one, 3, 2)
    with pytest.raises(ValueError, match="without state"):
        archive.publish("2026-01-01", "r1", one, 3, None)
    with pytest.raises(ValueError, match="no rows in sources"):
        archive.publish("2026-01-01", "r1", one | {"sources": one["sources"].limit(0)}, 3, 3)
    assert archive.latest() is None and archive.usable("2026-01-01") == (None, [])
    archive.publish("2026-01-01", "r 1/", one, 3, 3)
    archive.publish("2026-01-04", "r4", one, 3, 3)
    archive.publish("2026-01-02", "r2", one, 3, 3)
    assert archive.latest()["day"] == "2026-01-04"
    with pytest.raises(FileExistsError):
        archive.publish("2026-01-02", "r2", one, 3, 3)
    # a newer run of the second day died; that of the fourth day has lost a table, and a day later there is a broken manifest
    rows(spark, [(1, "x")]).write.parquet(f"{tmp_path}/runs/2026-01-02/r9/canonical")
    os.rename(f"{tmp_path}/runs/2026-01-04/r4/sources", f"{tmp_path}/elsewhere")
    os.makedirs(f"{tmp_path}/runs/2026-01-05/r5")
    open(f"{tmp_path}/runs/2026-01-05/r5/manifest.json", "w").write("{")
    found = {r["day"]: r for r in archive.audit("2026-01-05", 5).collect()}
    assert [d for d, r in found.items() if r["ok"]] == ["2026-01-01", "2026-01-02"]
    assert found["2026-01-01"]["run_id"] == "r1" and found["2026-01-01"]["rows"] == {"canonical": 1, "sources": 1}
    assert found["2026-01-02"]["run_id"] == "r2" and found["2026-01-02"]["ignored"][0].startswith("r9: FileNotFoundError")
    assert found["2026-01-03"]["error"] == "no run was published"
    assert "PATH_NOT_FOUND" in found["2026-01-04"]["error"] and "JSONDecodeError" in found["2026-01-05"]["error"]
    assert {(r["archive_day"], r["v"]) for r in archive.read(archive.audit("2026-01-05", 5), "canonical").collect()} == {("2026-01-01", "a"), ("2026-01-02", "a")}
