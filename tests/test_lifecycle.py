"""The state machine on a stream against a plain loop, with restarts."""

import random
from datetime import datetime, timedelta

from talus.streaming import lifecycle

SCHEMA = "k string, t timestamp, n long, title string, state string, other int"


def plain(rows):
    held, out = {}, {}
    for k, t, n, title, s, _ in sorted((r for r in rows if r[1]), key=lambda r: (r[1], r[2])):
        new = [title, s]
        if k not in held:
            told, why, first, times = "NEW", [], t, 0
        else:
            first, times, old = held[k]
            why = [c for c, a, b in zip(("title", "state"), old, new) if a != b]
            told = "REOPENED" if old[1] == "CLOSED" and s in ("OPEN", "OPEN_UNTIL_FILLED") else "MATERIALLY_CHANGED" if why else "SEEN"
        held[k] = (first, times + 1, new)
        out[n] = (k, told, why, times + 1, first)
    return out


def test_lifecycle_over_restarts(spark, tmp_path):
    r = random.Random(2)
    start = datetime(2024, 1, 1)
    rows = [(r.choice(["a", "b", "c", None]), start + timedelta(minutes=10 * i), i, r.choice(["x", "x", "y", None]), r.choice(["OPEN", "CLOSED", "OPEN_UNTIL_FILLED"]), i) for i in range(90)] + [("a", None, 999, "x", "OPEN", 0)]
    got = {}
    for part in (rows[:40], [], rows[40:]):
        if part:
            spark.createDataFrame(part, SCHEMA).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        out = lifecycle.run(spark, lifecycle.lifecycle(stream, "k", "t", "n", ["title", "state"], "state"), f"file://{tmp_path}/s")
        got = {x["n"]: (x["k"], x["seen_status"], x["change_reasons"], x["times_seen"], x["first_seen"]) for x in out.collect()}
    assert got == plain(rows)
    late = [("a", start - timedelta(days=1), 500, "z", "OPEN", 0), ("a", start + timedelta(days=9), 501, rows[-2][3], "OPEN", 0)]
    spark.createDataFrame(late, SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    out = {x["n"]: x for x in lifecycle.run(spark, lifecycle.lifecycle(stream, "k", "t", "n", ["title", "state"], "state"), f"file://{tmp_path}/s").collect()}
    assert out[500]["seen_status"] == "LATE" and out[501]["first_seen"] == start - timedelta(days=1) and "z" not in out[501]["change_reasons"]
    assert len(out) == 92
