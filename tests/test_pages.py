"""The source of captured pages: what is opened, what comes out, and streams that go on."""

import json
import os

import pytest
from pyspark.sql import functions as F

from talus.sources import pages


def put(folder, source, day, first, last, lines=None):
    at = f"{folder}/{source}/{day}"
    os.makedirs(at, exist_ok=True)
    with open(f"{at}/{first}-{last}.jsonl", "w", encoding="utf-8") as f:
        for n in range(first, last + 1):
            f.write((lines or (lambda n: json.dumps({"page": n, "url": f"https://e.org/{source}?p={n}", "fetched_at": day, "body": f"é {n}"})))(n) + "\n")


@pytest.fixture
def folder(tmp_path, spark):
    pages.register(spark)
    for source in ("a", "b"):
        for day in ("2026-01-01", "2026-01-02"):
            for first in (1, 4, 7):
                put(tmp_path, source, day, first, first + 2)
    # whoever opens these files fails: they are folders
    os.makedirs(f"{tmp_path}/shut/2026-01-01/1-3.jsonl")
    os.makedirs(f"{tmp_path}/a/2026-01-03/10-12.jsonl")
    os.makedirs(f"{tmp_path}/b/2026-01-02/100-200.jsonl")
    return str(tmp_path)


def read(spark, folder, **options):
    return spark.read.format("captured_pages").options(**options).load(folder)


def test_only_the_files_asked_for_are_opened(spark, folder):
    with pytest.raises(Exception, match="shut|10-12|100-200|Is a directory|directory"):
        read(spark, folder).collect()
    ours = F.col("source").isin("a", "b") & F.col("day").isin("2026-01-01", "2026-01-02") & (F.col("page") < 100)
    assert read(spark, folder).where(ours).count() == 36
    got = read(spark, folder).where("source = 'a' AND day = '2026-01-02' AND page BETWEEN 5 AND 7").collect()
    assert sorted((x["page"], x["body"], x["day"]) for x in got) == [(n, f"é {n}", "2026-01-02") for n in (5, 6, 7)]
    assert read(spark, folder).where("source = 'none'").count() == 0
    assert read(spark, "file://" + folder).where("source = 'b' AND day = '2026-01-01' AND page = 9").count() == 1


def test_tasks_are_runs_of_one_source(spark, folder):
    one = os.path.getsize(f"{folder}/a/2026-01-01/1-3.jsonl")
    ask = lambda target: read(spark, folder, target_bytes=str(target)).where("source IN ('a', 'b') AND day IN ('2026-01-01', '2026-01-02') AND page < 100").rdd.getNumPartitions()
    assert (ask(1 << 30), ask(2 * one), ask(1)) == (2, 6, 12)


def test_broken_lines_and_absent_folders(spark, tmp_path):
    pages.register(spark)
    put(tmp_path, "x", "2026-01-01", 1, 2, lambda n: '{"page": 1, "body": "fine"}' if n == 1 else '{"page": 2, "bo')
    got = {x["page"]: x for x in read(spark, str(tmp_path)).collect()}
    assert got[1]["body"] == "fine" and got[1]["url"] is None and got[None]["url"].endswith("1-2.jsonl")
    assert read(spark, f"{tmp_path}/none").count() == 0


def test_a_stream_goes_on_behind_what_it_has_read(spark, tmp_path):
    pages.register(spark)
    folder, seen = f"{tmp_path}/in", []

    def run():
        stream = spark.readStream.format("captured_pages").load(folder)
        take = lambda rows, n: seen.append(sorted((x["source"], x["page"]) for x in rows.collect()))
        stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
        return [x for batch in seen for x in batch]

    put(folder, "a", "2026-01-01", 1, 2)
    assert run() == [("a", 1), ("a", 2)]
    seen.clear()
    assert run() == []
    put(folder, "a", "2026-01-01", 3, 3)
    put(folder, "b", "2026-01-02", 1, 1)
    assert run() == [("a", 3), ("b", 1)]


def test_missing_pages(spark):
    rows = spark.createDataFrame([("a", 1, 121), ("a", 3, 130), ("b", 1, None), ("c", 1, 60), ("d", 9, 0)], "scan string, page int, total int")
    got = pages.missing_pages(rows, "scan", "page", F.col("total"), 60).collect()
    assert sorted(map(tuple, got)) == [("a", 2)]
    assert pages.missing_pages(rows.limit(0), "scan", "page", F.col("total"), 60).count() == 0
