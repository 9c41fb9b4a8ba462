"""As-of joins against a plain loop."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from talus.operators import asof

ROWS, ENTRIES = "k string, g string, t timestamp, n int, v string, clash string", "k string, g string, s timestamp, i int, v string, days int"


def some(r, n, m):
    day = lambda: r.choice([None, *[datetime(2024, 1, 1) + timedelta(hours=r.randint(0, 400)) for _ in range(9)]])
    key = lambda: r.choice(["hot", "hot", "hot", "a", "b", None])
    return [(key(), r.choice(["x", "y", None]), day(), i, "old", "c") for i in range(n)], [(key(), r.choice(["x", "y", None]), day(), i // 2, f"v{i // 2}", r.randint(0, 4)) for i in range(m)]


@pytest.mark.parametrize("same,days,oldest,before", [((), False, None, False), (("g",), False, 3 * 86_400, False), ((), True, 5 * 86_400, True)])
def test_asof_against_a_loop(spark, same, days, oldest, before):
    rows, entries = some(random.Random(1), 300, 200)
    entries += entries[:9]  # repeated entries change nothing
    origin = F.expr("s - make_dt_interval(days)") if days else None
    left, right = spark.createDataFrame(rows, ROWS).repartition(5), spark.createDataFrame(entries, ENTRIES).repartition(3)
    got = {x["n"]: (x["v"], x["age_seconds"], x["clash"], x["k"]) for x in asof.asof_join(left, right, ["k"], "t", "s", ["v"], ["i"], same, origin, oldest, before).collect()}
    assert len(got) == len(rows)
    hit = 0
    for k, g, t, n, _, c in rows:
        best = None
        for ek, eg, s, i, v, d in entries:
            if None in (k, t, ek, s) or k != ek or same and (g is None or g != eg) or (s >= t if before else s > t):
                continue
            here = (s - timedelta(days=d if days else 0), i, v)
            best = here if best is None or here > best else best
        age = (t - best[0]).total_seconds() if best else None
        counts = best is not None and (oldest is None or age <= oldest)
        assert got[n] == ((best[2], age, c, k) if counts else (None, None, c, k)), n
        hit += counts
    assert hit


def test_asof_of_nothing(spark):
    rows, entries = some(random.Random(2), 5, 5)
    left, right = spark.createDataFrame(rows, ROWS), spark.createDataFrame(entries, ENTRIES)
    assert asof.asof_join(left.limit(0), right, ["k"], "t", "s", ["v"]).count() == 0
    assert {x["v"] for x in asof.asof_join(left, right.limit(0), ["k"], "t", "s", ["v"]).collect()} == {None}
