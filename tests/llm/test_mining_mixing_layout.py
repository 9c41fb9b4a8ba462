"""Hard negatives, source mixes and the clustered layout against brute force, and on odd tables."""

import itertools
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from talus.llm import clustered, mixing, negatives

CLASH = ("id", "row", "rank", "label2", "z", "file", "position", "size", "taken", "pattern", "order", "part", "b", "c", "query", "dist", "sources")


def clashing(df):
    for c in CLASH:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("clash"))
    return df


# -- hard negatives


def brute(rows, positives=5, negatives_=10, low=30, high=90):
    """rows: id -> (label, vector, anchor)."""
    out = set()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a, (label, v, is_anchor) in rows.items():
        if not is_anchor:
            continue
        score = sorted((-dot(v, w), i, other) for i, (other, w, _) in rows.items() if i != a)
        own = [(i, -s) for s, i, other in score if other == label][:positives]
        for p, ps in own:
            found = [(i, -s) for s, i, other in score if other != label and low * ps <= -100 * s <= high * ps][:negatives_]
            out |= {(a, p, n, i, ps, s) for n, (i, s) in enumerate(found, 1)}
    return out


def mined(df):
    return [(x["anchor_id"], x["positive_id"], x["rank"], x["negative_id"], x["positive_score"], x["negative_score"]) for x in df.collect()]


@pytest.mark.parametrize("copies", [0, 150])
def test_op11_against_brute_force_in_small_tiles(spark, monkeypatch, copies):
    monkeypatch.setattr(negatives, "BLOCK", 40)
    monkeypatch.setattr(negatives, "CHUNK", 7)
    r = random.Random(copies)
    rows = {i: (r.choice([0, 0, 0, 1, 2, -5]), [r.randint(-9, 30) for _ in range(6)], i % 10 == 0) for i in range(300)}
    for i in range(copies):  # a third of the rows is one vector, of two labels
        rows[400 + i] = (i % 2, [5, 5, 5, 5, 5, 5], i % 10 == 0)
    rows[997], rows[998] = (7, [1] * 6, True), (8, [-3] * 6, True)  # without others of their label
    df = spark.createDataFrame([(i, *x) for i, x in rows.items()], "vec_id long, label long, embedding array<long>, asks boolean")
    odd = spark.createDataFrame([(None, 0, [1], True), (1001, None, [1], True), (1002, 0, None, True), (1003, 0, [1, None], True), (3, 9, [9], True)], df.schema)
    got = mined(negatives.mine(clashing(df.unionByName(odd).unionByName(df.limit(30))), "vec_id", F.col("label"), F.col("embedding"), F.col("asks")))
    want = brute(rows)
    assert len(got) == len(set(got)) and set(got) == want and want


def test_op11_brackets_hold_every_score():
    r = np.random.default_rng(3)
    for scale in (1, 1000, 10**7):
        v = r.integers(-scale, scale + 1, (200, 8))
        most = float((v.astype(float) ** 2).sum(axis=1).max())
        pivots = negatives.choose(v[:50], most, 6)
        far = negatives.distances(negatives.augmented(v, most), pivots)
        lists = lambda m: pa.array(m.tolist(), pa.list_(pa.int64()))
        q = v[::20]
        table = pa.table({"id": list(range(200)) + list(range(10)), "label": [0] * 210, "vector": pa.concat_arrays([lists(v), lists(q)]), "dist": pa.array(far.tolist() + [None] * 10, pa.list_(pa.float64())), "query": [False] * 200 + [True] * 10})
        tile = negatives.Tile(table, 8, pivots, most)
        passed = 0
        for i in range(10):
            low, high = tile.brackets(i)
            exact = v @ q[i]
            assert (low <= exact).all() and (exact <= high).all()
            passed += (high < exact.max()).sum()
        assert passed  # some vectors can be passed over


def test_op11_large_components_and_ragged_vectors(spark):
    big = 2**40
    rows = [(0, 0, [big, big], True), (1, 0, [big, 1], False), (2, 1, [big // 2], False), (3, 1, [1, big // 3, 0], False), (4, 1, [], False)]
    df = spark.createDataFrame(rows, "vec_id long, label long, embedding array<long>, asks boolean")
    got = mined(negatives.mine(df, "vec_id", F.col("label"), F.col("embedding"), F.col("asks")))
    most = 2**63 - 1
    assert set(got) <= {(0, 1, n, i, most, most) for n in (1, 2) for i in (2, 3)}  # beyond 64 bits: the nearest number
    assert negatives.mine(df.limit(0), "vec_id", F.col("label"), F.col("embedding"), F.col("asks")).count() == 0


def test_op11_query_rules(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 3, [0.5, 0.25]), (100, 4, [0.5, 0.5]), (7, 3, [0.5, 0.5]), (14, 9, [0.3, 0.3]), (1, 3, [0.4, 0.4]), (2, 4, [0.2, 0.3]), (3, 4, [nan, 1.0]), (4, 4, [inf, 1.0]), (5, None, [1.0, 1.0]), (6, 4, None), (8, 4, [None, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    own = {}
    for i, label, v in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            own[i] = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(float(np.float32(x)) * 256) for x in v], i % 100 == 0)
    assert set(mined(negatives.of_embeddings(clashing(df)))) == brute(own)


# -- source mixes


def water(sizes, weights, repeats=3):
    """The targets by the words of the rule: share, cap, share the excess again."""
    total, capped, out = sum(sizes), set(), [0.0] * len(sizes)
    while True:
        left = total - sum(repeats * sizes[i] for i in capped)
        free = [i for i in range(len(sizes)) if i not in capped]
        for i in range(len(sizes)):
            out[i] = float(repeats * sizes[i]) if i in capped else left * weights[i] / sum(weights[k] for k in free)
        above = {i for i in free if out[i] > repeats * sizes[i]}
        if not above:
            return out
        capped |= above


def test_op12_targets_are_those_of_the_rule():
    r = random.Random(5)
    for _ in range(300):
        n = r.randint(1, 8)
        sizes, weights = [r.choice([0, 1, 5, 40, 1000, r.randint(0, 10**6)]) for _ in range(n)], [(5, 2, 1)[i % 3] for i in range(n)]
        assert mixing.fill(sizes, weights, sum(sizes)) == pytest.approx(water(sizes, weights))
    assert mixing.fill([], [], 0) == []


def cheapest(patterns, quotas, repeats):
    """(words placed, cost) of the best whole flow, by trying all of them."""
    pairs = [(p, s) for p in patterns for s in p]
    best = (-1, 0)
    for amounts in itertools.product(*(range(min(repeats * patterns[p], quotas[s]) + 1) for p, s in pairs)):
        used, got = Counter(), Counter()
        for (p, s), n in zip(pairs, amounts):
            used[p] += n
            got[s] += n
        if any(used[p] > repeats * patterns[p] for p in patterns) or any(got[s] > quotas[s] for s in quotas):
            continue
        cost = sum(sum(k // patterns[p] for k in range(used[p])) for p in patterns if patterns[p])
        best = max(best, (sum(got.values()), -cost))
    return best


def test_op12_flow_is_the_cheapest():
    r = random.Random(8)
    for _ in range(60):
        patterns = {p: r.randint(0, 3) for p in r.sample([("a",), ("b",), ("a", "b"), ("b", "c")], r.randint(1, 3))}
        quotas = {s: r.randint(0, 4) for p in patterns for s in p}
        given = mixing.flow(patterns, quotas, 2)
        used, got = Counter(), Counter()
        for (p, s), n in given.items():
            used[p] += n
            got[s] += n
        assert all(used[p] <= 2 * patterns[p] for p in patterns) and all(got[s] <= quotas[s] for s in quotas)
        cost = sum(sum(k // patterns[p] for k in range(used[p])) for p in used if patterns[p])
        assert (sum(got.values()), -cost) == cheapest(patterns, quotas, 2), (patterns, quotas)


def some_docs(r, n):
    return [(i, None if r.random() < 0.05 else "w " * r.choice([0, 1, 7, 30, r.randint(0, 400)]), r.choice([*("hot" for _ in range(8)), "a", "b", "", None])) for i in range(n)]


def test_op12_words_add_up_to_the_quotas(spark):
    rows = some_docs(random.Random(2), 400)
    rows += rows[:20] + [(None, "x y z", "hot")] * 3
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    one = mixing.document_mix(df.repartition(7)).collect()
    assert len(one) == len(rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    target = dict(zip(names, water([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    taken, by_source = Counter(), defaultdict(list)
    for x in one:
        (s,) = x["sources"]
        assert s["size"] == size[s["source"]] and s["target"] == pytest.approx(target[s["source"]])
        assert 0 <= x["taken"] <= 3 * x["size"]
        taken[s["source"]] += x["taken"]
        by_source[s["source"]].append((x["size"], x["taken"]))
    for s, t in target.items():
        assert abs(taken[s] - t) <= 1
        # all documents of a source are taken equally often or once more, but for the one that is cut
        times = {n // k for k, n in by_source[s] if k and n % k == 0}
        assert len(times) <= 2 and max(times) - min(times) <= 1 and sum(n % k > 0 for k, n in by_source[s] if k) <= 1
    plain = lambda found: sorted((x["doc_id"] or -1, x["size"], x["taken"], str(x["sources"])) for x in found)
    assert plain(one) == plain(mixing.document_mix(df.orderBy(F.desc("doc_id")).coalesce(1)).collect())
    assert mixing.document_mix(df.limit(0)).count() == 0
    assert {x["taken"] for x in mixing.document_mix(df.withColumn("text", F.lit(" "))).collect()} == {0}


def test_op12_overlapping_sources_share_their_documents(spark):
    r = random.Random(4)
    rows = [(i, r.choice([["a"], ["a", "b"], ["b", "c", "b"], ["c", None], [], None]), r.randint(1, 50)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, of array<string>, n long")
    got = {x["doc_id"]: x for x in mixing.mix(df, "doc_id", F.col("of"), F.col("n")).collect()}
    assert all(got[i]["taken"] == 0 for i, of, _ in rows if not of) and all(x["taken"] <= 3 * x["size"] for x in got.values())
    targets = {s["source"]: s["target"] for x in got.values() for s in x["sources"]}
    assert sum(x["taken"] for x in got.values()) == sum(math.floor(t + 0.5) for t in targets.values())


# -- the clustered layout


def plain_layout(rows, per_file):
    """(key, source, lang, length, date) rows: key -> what the layout says, by loops over all rows."""
    dims = list(zip(*(r[1:] for r in rows))) if rows else []
    order = {k: sorted((v is not None, v.encode() if isinstance(v, str) else v) if v is not None else (False, 0) for v in column) for k, column in enumerate(dims)}
    at = lambda k, v: sum(x < ((v is not None, v.encode() if isinstance(v, str) else v) if v is not None else (False, 0)) for x in order[k])
    cells = [tuple(16 * at(k, v) // len(rows) for k, v in enumerate(r[1:])) for r in rows]
    z = []
    for s, g, length, d in cells:
        bits = "".join(f"{c:04b}"[n] for n in range(4) for c in (length, s, d, g))
        z.append(int(bits, 2))
    place = sorted(range(len(rows)), key=lambda i: (z[i], rows[i][0] is not None, rows[i][0] or 0))
    file = {i: n // per_file for n, i in enumerate(place)}
    held = defaultdict(list)
    for i, f in file.items():
        held[f].append(cells[i])
    bounds = {f: [x for k in range(4) for x in (min(c[k] for c in cs), max(c[k] for c in cs))] for f, cs in held.items()}
    out = []
    for n, i in enumerate(place):
        c = cells[i]
        box = [(c[0], c[0]), (c[1], c[1]), (c[2] - 2, c[2] + 2), (c[3] - 2, c[3] + 2)]
        touched = sum(all(b[2 * k] <= hi and b[2 * k + 1] >= lo for k, (lo, hi) in enumerate(box)) for b in bounds.values())
        matching = sum(any(all(lo <= x[k] <= hi for k, (lo, hi) in enumerate(box)) for x in cs) for cs in held.values())
        out.append((rows[i][0], z[i], n, file[i], bounds[file[i]], touched, matching))
    return sorted(out, key=lambda x: x[2])


@pytest.mark.parametrize("seed,n,per_file", [(0, 250, 9), (1, 120, 500), (2, 1, 5)])
def test_op13_against_loops(spark, seed, n, per_file):
    r = random.Random(seed)
    docs = [(r.choice([None, *range(10_000)]) if i % 9 == 0 else i * 7, "é" * r.choice([0, 1, 5, r.randint(0, 60)]) if r.random() > 0.1 else None, r.choice(["hot", "hot", "hot", "a", "É", "", None]), r.choice(["en", "fr", None])) for i in range(n)]
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")).repartition(5)
    plain = [(i, s, g, -1 if t is None else len(t.encode()), None if i is None else zlib.crc32(str(i).encode()) % 365) for i, t, s, g in docs]
    got = clustered.layout(df, "doc_id", clustered.document_dimensions(), ["length", "source", "date", "lang"], {"source": 0, "lang": 0, "length": 2, "date": 2}, per_file).collect()
    out = sorted(((x["doc_id"], x["z"], x["position"], x["file"], list(x["bounds"]), x["files_touched"], x["files_matching"]) for x in got), key=lambda x: x[2])
    assert out == plain_layout(plain, per_file)


def test_op13_of_nothing_and_other_dimensions(spark):
    df = spark.createDataFrame([(i, i % 5, -i) for i in range(60)], "k long, a int, b long")
    args = {"a": F.col("a"), "b": F.col("b")}, ["b", "a"], {"a": 1, "b": 3}, 4, 8
    got = clustered.layout(df, "k", *args).collect()
    assert sorted(x["position"] for x in got) == list(range(60)) and max(x["file"] for x in got) == 14
    assert all(1 <= x["files_matching"] <= x["files_touched"] <= 15 for x in got)
    assert clustered.layout(df.limit(0), "k", *args).count() == 0


def test_op13_files_are_written_in_order(spark, tmp_path):
    df = spark.createDataFrame([(i, "t" * (i % 40), f"s{i % 7}", "en", "kept") for i in range(1000)], "doc_id long, text string, source string, lang string, z string")
    placed = clustered.document_layout(df)
    clustered.write(df, "doc_id", placed, str(tmp_path / "out"), rows_per_file=50, files_per_task=3)
    held = {}
    for f in os.listdir(tmp_path / "out"):
        if f.endswith(".parquet"):
            p = pq.read_table(tmp_path / "out" / f)["position"].to_pylist()
            assert p == list(range(p[0], p[0] + len(p))) and p[0] % 50 == 0 and len(p) <= 50
            held[p[0] // 50] = p
    assert sorted(held) == list(range(20))
    z = sorted(x["z"] for x in placed.collect())
    assert sorted(x["z"] for x in clustered.read(spark, str(tmp_path / "out"), z[100], z[200]).collect()) == [x for x in z if z[100] <= x <= z[200]]
    with pytest.raises(Exception, match="not unique"):
        clustered.write(df.unionByName(df.limit(1)), "doc_id", clustered.document_layout(df.unionByName(df.limit(1))), str(tmp_path / "twice"))
