"""Registered queries of the core against DuckDB on the smallest tables."""

import os

import pytest

from talus.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
SLOW: set[str] = set()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(SF):
        path = f"{SF}/{name}"
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(x):
    return round(float(x), 6) if isinstance(x, float) else int(x) if isinstance(x, bool) else x


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SLOW))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    if name not in ORACLE_SQL:
        return
    want = duck.execute(ORACLE_SQL[name])
    at = {d[0]: i for i, d in enumerate(want.description)}
    assert sorted(at) == columns
    assert rows == sorted((tuple(plain(r[at[c]]) for c in columns) for r in want.fetchall()), key=repr)


def test_fuzzy_title_ratio_loses_no_pair(spark):
    from difflib import SequenceMatcher
    from itertools import combinations

    sf = SF.replace("sf0.001", "sf0.01")
    rows = spark.read.parquet(f"{sf}/customer.parquet").orderBy("c_custkey").collect()
    same = [(a, b) for a, b in combinations(rows, 2) if (a.c_nationkey, a.c_mktsegment) == (b.c_nationkey, b.c_mktsegment)]
    want = {(a.c_custkey, b.c_custkey): r for a, b in same if (r := SequenceMatcher(None, a.c_name, b.c_name).ratio()) >= 0.9}
    got = QUERIES["fuzzy_title_ratio"](spark, sf).collect()
    assert len(got) == len(want)
    assert {(x.a, x.b): pytest.approx(x.ratio) for x in got} == want


def test_greedy_resolution_equals_one_fold_over_all(spark):
    from plain import one_fold

    from talus.plans.queries import _listings, _table

    rows = [r.asDict() for r in _listings(lambda name: _table(spark, SF, name)).collect()]
    assert {x["ord"]: x["rep"] for x in QUERIES["greedy_resolution"](spark, SF).collect()} == one_fold(rows)


@pytest.mark.parametrize("name", ["html_text", "html_title"])
def test_pages_read_the_references_of_their_sql(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    titles = ["a&&& b&amp", "&amp;lt; &lt;b&gt; &quot;q&quot; &#39;s&#39;", "&eacute; &copy &nbsp;x&", "&amp;amp", "&bogus; &#233;"]
    spark.createDataFrame([(i, f"<title>{x}</title><p>{x}</p>") for i, x in enumerate(titles)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = duckdb.sql(ORACLE_SQL[name].replace("FROM pages", f"FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")).fetchall()
    assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == sorted(want)


def test_alike_loses_no_pair_and_meets_few(spark):
    import random
    from difflib import SequenceMatcher
    from itertools import combinations

    from talus.functions import text

    r = random.Random(5)
    names = ["", "a", "aa"]
    for n in (3, 10, 15, 18, 19, 20, 22, 40, 44):
        for _ in range(4):
            x = "".join(r.choices("abc", k=n))
            names.append(x)
            for _ in range(4):
                y = list(x)
                for _ in range(r.randint(1, 4)):
                    y[r.randrange(len(y)) : r.randrange(len(y)) + 1] = r.choice(["", "a", "bc"])
                    y = y or ["c"]
                names.append("".join(y))
    names = list(dict.fromkeys(names))
    rows = [(i, 1, x) for i, x in enumerate(names)]
    got = {(p.a, p.b) for p in text.alike(spark.createDataFrame(rows, "k long, g int, s string"), "k", ["g"], "s", 0.9).collect()}
    want = {(i, j) for (i, _, x), (j, _, y) in combinations(rows, 2) if SequenceMatcher(None, x, y).ratio() >= 0.9}
    assert len(want) > 50 and want <= got
    numbered = spark.range(3000).selectExpr("id AS k", "1 AS g", "concat('Customer#', lpad(id * 331 % 999983, 9, '0')) AS s")
    assert text.alike(numbered, "k", ["g"], "s", 0.9).count() < 30 * 3000


def test_fuzzy_title_ratio_takes_equal_names_once(spark, tmp_path):
    rows = [(i, "abcdefghijklmnopqrs" + "xy"[i % 2], 1, "S") for i in range(20)] + [(20, "abcdefghijklmnopqrsx", 2, "S"), (21, None, 1, "S")]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got = sorted((x.a, x.b, round(x.ratio, 6)) for x in QUERIES["fuzzy_title_ratio"](spark, str(tmp_path)).collect())
    assert got == sorted([(0, 1, 0.95), *((i % 2, i, 1.0) for i in range(2, 20))])


def test_batches_of_the_seen_history_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    from talus.streaming.seen import SeenHistory

    spark.range(250_000).selectExpr("id % 100 AS user_id", "timestamp_seconds(id) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    numbers, batch = [], SeenHistory.batch
    monkeypatch.setattr(SeenHistory, "batch", lambda self, rows, n: (numbers.append(n), batch(self, rows, n))[1])
    got = QUERIES["stream_seen_history"](spark, str(tmp_path)).collect()
    assert len(got) == 100 and sum(x.times_seen for x in got) == 250_000
    assert 8 < len(numbers) <= 16


def test_simhash_is_one_pass_and_equals_a_loop(spark):
    import hashlib

    from pyspark.sql import functions as F

    from talus.functions import text

    def plain(w):
        h = [int(hashlib.md5(" ".join(w[i : i + 3]).encode()).hexdigest()[:15], 16) for i in range(len(w) - 2)]
        return sum(1 << b for b in range(60) if 2 * sum(x >> b & 1 for x in h) >= len(h)) if len(w) >= 25 else None

    texts = [["é\u4e2d", "b c"] * 20, list("abcdefghijklmnopqrstuvwxy"), list("abcdefghijklmnopqrstuvwx"), [], ["x"] * 500]
    out = text.simhash(spark.createDataFrame(list(enumerate(texts)), "k int, w array<string>"), ["k"], "w")
    assert "aggregate(" not in out._jdf.queryExecution().executedPlan().toString()
    assert dict(out.collect()) == {i: plain(w) for i, w in enumerate(texts)}


def test_gaps_replace_negated_demands_once(spark):
    from pyspark.sql import functions as F

    from talus.functions import rules

    sought = {"by": [r"\bby\b"], "with": [r"\bwith\b"], "que": [r"\bque\b"]}
    rows = ["it is by hand and with que", "with a b c thereof", "thereof " + "x " * 40 + "que", "it is of the by", "", None]
    gaps = rules.qualification_gaps(F.col("t"), sought, [r"\bof the\b"], [r"\bit is\b"], [r"\band\b"], ["thereof"], 60)
    out = spark.createDataFrame([(x,) for x in rows], "t string").select(gaps.alias("g"))
    assert [x.g for x in out.collect()] == [["by"], ["with"], [], ["by"], [], []]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("optional") == 1


def test_state_advance_stages_compressed(spark):
    from pathlib import Path

    QUERIES["state_advance"](spark, SF).count()
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = set(folder.glob("rdd-*"))
    QUERIES["state_advance"](spark, SF).count()
    assert set(folder.glob("rdd-*")) == before


def test_state_advance_keeps_and_moves_little(spark):
    from pathlib import Path

    from pyspark.sql import functions as F

    from talus.operators import state

    QUERIES["state_advance"](spark, SF).count()
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = set(folder.glob("staged-*"))
    QUERIES["state_advance"](spark, SF).count()
    left = [set(spark.read.parquet(str(p)).columns) for p in set(folder.glob("staged-*")) - before if list(p.glob("part-*"))]
    assert left and not any(x & {"strong", "trusted", "old"} for x in left)
    held = spark.range(9).select(F.col("id").cast("string").alias("state_id"), F.array(F.lit("x"), F.col("id").cast("string")).alias("aliases"))
    index = state.alias_index(held)
    assert index._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, index.collect())) == [(str(i), str(i)) for i in range(9)]
