"""Collectors, scan control, rule engines, details, stores and reports on small data of their own."""

import json
import random
from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F

from talus import engine
from talus.functions import extract, nested, rules, text
from talus.operators.commits import Conflict
from talus.operators import audit, cache, dedup, report, scan, state, store
from talus.sources import collect, payloads
from talus.streaming.seen import SeenHistory, windowed_counts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_collectors_keep_prefer_and_account(spark):
    body = "<p>5 offers</p><h2>Closed 2024</h2><a href='/j/9'>Old</a><h2>Open 2026</h2><a href=\"/j/1\"></a><a href='/j/1'>One <b>&amp; more</b></a><a href='/x'>no</a><a href='https://o.org/j/2'>Two</a><a href='/j/3'>Dr Three</a>"
    rows = spark.createDataFrame([("s", "u1", body), ("s", "u2", None), ("t", "u", "")], "source string, url string, body string")
    item = collect.links(r"/j/[0-9]+$", "https://e.org")
    fields = {"url": lambda x: x["href"], "title": lambda x: x["title"]}
    c = collect.Collector("s", item, fields, keep=lambda: ~F.col("title").startswith("Dr"), prefer=lambda: F.length("title"), declared=r"([0-9]+) offers", most=2)
    got, found = collect.collect(rows, c)
    assert [(r["url"], r["title"]) for r in got.collect()] == [("https://e.org/j/9", "Old"), ("https://e.org/j/1", "One & more")]
    assert found.first().asDict() == {"source": "s", "bodies": 2, "declared": 5, "parsed": 5, "kept": 4, "unique": 3, "truncated": 1, "complete": False}
    for way in (collect.section("open", item), collect.latest_year(item)):
        inside = collect.collect(rows, collect.Collector("s", way, fields))[0].collect()
        assert {r["url"] for r in inside} == {"https://e.org/j/1", "https://o.org/j/2", "https://e.org/j/3"}
    other = collect.one_or_other(collect.links("nothing"), item)
    assert collect.collect(rows, collect.Collector("s", other, fields))[0].count() == 4
    none, found = collect.collect(rows, collect.Collector("absent", item, fields))
    assert none.count() == 0 and found.first()["complete"] is False


def test_captured_payloads_source(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps({"source": "s", "url": "u", "body": "b"}) + "\nnot json\n")
    (tmp_path / "b.jsonl").write_text("")
    collect.register(spark)
    rows = spark.read.format("captured").load(str(tmp_path)).collect()
    assert sorted((r["source"] or "", r["body"]) for r in rows) == [("", None), ("s", "b")]
    (tmp_path / "none").mkdir()
    assert spark.read.format("captured").load(str(tmp_path / "none")).count() == 0


def test_scans_stop_for_the_first_reason(spark):
    pages = [("a", 1, None, 2, "x", date(2026, 1, 9), False), ("a", 2, None, 2, "x", None, False), ("b", 1, "E", 0, "y", None, False), ("c", 1, None, 1, "z", date(2020, 1, 1), True), ("d", 1, None, 1, "q", None, True), ("e", 1, None, 1, "r", None, None), ("f", 1, None, 0, "r", None, None)]
    df = spark.createDataFrame(pages, "s string, p int, err string, n int, sig string, day date, last boolean")
    got = scan.stops(df, "s", "p", F.col("err"), F.col("n"), F.col("sig"), F.col("day"), F.col("last"), F.lit(date(2025, 1, 1)))
    assert {r["s"]: (r["stop_page"], r["stop_reason"], r["repeated"]) for r in got.collect()} == {"a": (2, "repeat", True), "b": (1, "error", False), "c": (1, "cutoff_reached", False), "d": (1, "last_page", False), "e": (1, None, False), "f": (1, "empty_page", False)}
    assert {(r["s"], r["p"]) for r in scan.read(df, got, "s", "p").collect()} == {("a", 1), ("c", 1), ("d", 1), ("e", 1)}
    limited = scan.stops(df, "s", "p", F.col("err"), F.col("n"), F.col("s"), F.col("day"), F.lit(None).cast("boolean"), page_limit=1)
    assert {r["stop_reason"] for r in limited.where("s = 'e'").collect()} == {"configured_page_limit"}
    assert one(spark, scan.covered(F.lit("cutoff_reached"), F.lit(0), F.lit(False), F.lit(True), cutoff=F.lit(date(2025, 1, 1)))) is True
    assert one(spark, scan.covered(F.lit("cutoff_reached"), F.lit(0), F.lit(False), F.lit(True))) is False
    assert one(spark, scan.detail_complete(F.lit(None).cast("int"))) is True and one(spark, scan.honoured(F.lit(1), F.lit(4), 0.5)) is False


def test_sources_facets_and_second_passes(spark, tmp_path):
    assert scan.select_sources(["a", "b", "c"], "both", {"both": ["c", "a"]}) == ["a", "c"] and scan.select_sources(["a"], "all") == ["a"]
    with pytest.raises(ValueError):
        scan.select_sources(["a"], "z")
    html = "<select name='c'><option value=''>Any</option><option value='7'>Spain</option><option value='8'>Spain</option></select>"
    assert one(spark, scan.facets(F.lit(html), "c")) == {"Spain": "7"}
    mark = str(tmp_path)

    def resolve(frames):
        import os

        for f in frames:
            out = []
            for k in f["k"]:
                path = os.path.join(mark, str(k))
                again = os.path.exists(path)
                open(path, "a").close()
                out.append((k, "OK" if k % 2 or again else "TIMEOUT"))
            yield pd.DataFrame(out, columns=["k", "status"])

    got = scan.resolved_twice(spark.range(6).withColumnRenamed("id", "k"), "k", resolve, "k long, status string", 2, "^TIMEOUT")
    assert sorted(tuple(r) for r in got.collect()) == [(k, "OK") for k in range(6)]


def test_rule_engines(spark):
    assert one(spark, rules.section(F.lit("intro required education phd in x desirable y"), ["required education"], ["desirable"])) == " phd in x "
    table = {"phd": [r"\bphd\b"], "law": [r"\blaw\b"]}
    ask = lambda t: one(spark, rules.qualification_gaps(F.lit(t), table, [r"\bnot required\b"], ["required education"], ["desirable"], [r"\brequired\b"], 10))
    assert ask("phd not required") == [] and ask("phd required") == ["phd"] and ask("required education a phd desirable law") == ["phd"]
    steps = [(F.lit(True), ["a"], "b"), (F.lit(True), ["b"], "c"), (F.lit(None).cast("boolean"), None, "z")]
    assert one(spark, rules.staged(F.lit("a"), steps)) == "c"
    wrong = rules.mismatch(F.lit("project manager"), F.lit("press media"), "project manager", "research", ["grant"], 1, {"x": ["press"], "y": ["media"]}, 2)
    assert tuple(one(spark, wrong)) == (True, "x,y")
    assert tuple(one(spark, rules.unscored(F.lit(None).cast("boolean"), F.lit(3), F.lit("APPLY")))) == (None, "NEEDS_DETAIL_REVIEW")


def test_details(spark):
    pages = spark.createDataFrame([(1, f"<body><div><nav>menu</nav><div><h1>The Title</h1><p>{'word ' * 150}</p></div></div><div>{'other ' * 50}</div></body>", "The  title"), (2, "<main>x</main>", "absent"), (3, None, None)], "id int, html string, title string")
    got = {r["id"]: r["block"] for r in pages.select("id", extract.title_block(F.col("html"), F.col("title")).alias("block")).collect()}
    assert got[1].startswith("The Title word") and "other" not in got[1] and got[2] == "x" and got[3] == ""
    assert one(spark, extract.urls_in(F.lit("see https://a.org/x, https://a.org/x and http://b.org)."))) == ["https://a.org/x", "http://b.org"]
    assert one(spark, extract.has_marker(F.lit("Access DENIED"), ["captcha", "access denied"])) is True
    assert one(spark, extract.html_links(F.lit("<a href='/a'>x</a><a class=q href = \"/b\">y</a>"))) == ["/a", "/b"]
    assert json.loads(one(spark, extract.json_ld(F.lit('<script type="application/ld+json">{"@type": "JobPosting", "a": 1}</script>'), "JobPosting")))["a"] == 1
    words = F.array(F.lit("gestion"), F.lit("proyectos"))
    assert one(spark, extract.identity_match(words, F.array().cast("array<string>"), F.lit("Gestión de Proyectos: requisitos y funciones " * 9), ["requisitos", "funciones"])) is True
    assert one(spark, nested.substantive(F.array().cast("array<struct<path:string,value:string,kind:string>>"), ("x",), body=F.lit("Requisitos y función " * 60), cues=("requisitos", "funcion"))) is True


def test_audits_and_caches(spark):
    assert one(spark, audit.warnings({"b": F.lit(True), "a": F.lit(False), "c": F.lit(True)})) == ["b", "c"]
    assert one(spark, audit.ratio(F.lit(1), F.lit(0), 1.0)) == 1.0
    assert one(spark, audit.coverage_complete(F.lit(True), F.lit(0), F.lit(None).cast("int"))) is True
    assert one(spark, audit.row_sources(F.array().cast("array<string>"), F.lit("A+B"))) == ["A", "B"]
    rows = spark.createDataFrame([("a", "OK"), ("a", None), ("a", "PARTIAL")], "s string, st string")
    assert tuple(audit.health(rows, ["s"], "st").first()) == ("a", 1, 1, 1)
    cached = spark.createDataFrame([("k", "x", 3, "old"), ("k", "x", 1, "young"), ("k", "y", 0, "other"), ("q", "x", 99, "stale")], "k string, g string, age int, v string")
    rows = spark.createDataFrame([("k", "x"), ("q", "x"), ("z", "x")], "k string, g string")
    got = {r["k"]: r["cached"] for r in cache.guarded_lookup(rows, cached, "k", ["g"], "v", F.col("age"), 10).collect()}
    assert got == {"k": "young", "q": None, "z": None}
    good, bad = payloads.fail_soft_union([("a", rows), ("b", ValueError("gone")), ("c", rows)])
    assert good.count() == 6 and bad == [("b", "gone")] and payloads.fail_soft_union([])[0] is None


def test_degraded_details_keep_what_is_known(spark):
    snap = "struct<title:string,company:string,location:string,application_deadline:string,application_status:string,resolved:boolean>"
    empty = spark.createDataFrame([], f"{store.STATE}, last_snapshot {snap}")
    day = lambda *rows: spark.createDataFrame([(i, [(0, "id|s|1")], s) for i, s in enumerate(rows)], f"ord long, aliases array<struct<rank:int,alias:string>>, snapshot {snap}")
    full, weak = ("t", "c", "Barcelona", "2026-01-01", "CLOSED", True), ("t", "", "Spain", "", "OPEN", False)
    _, s1 = state.advance(empty, day(full), F.lit("1"))
    seen, s2 = state.advance(s1, day(weak), F.lit("2"))
    r = seen.first()
    assert (r["seen_status"], r["change_reasons"], r["state_events"]) == ("MATERIALLY_CHANGED", ["company"], ["DETAIL_UNRESOLVED"])
    assert tuple(s2.first()["last_snapshot"]) == ("t", "c", "Barcelona", "2026-01-01", "CLOSED", True)
    seen, s3 = state.advance(s2, day(full), F.lit("3"))
    assert (seen.first()["seen_status"], seen.first()["state_events"]) == ("SEEN", [])
    seen, s4 = state.advance(s3, day(weak, full, weak), F.lit("4"))
    assert [x["state_events"] for x in seen.orderBy("ord").collect()] == [["DETAIL_UNRESOLVED"], [], ["DETAIL_UNRESOLVED"]]
    assert s4.first()["last_snapshot"]["location"] == "Barcelona"
    _, never = state.advance(empty, day(weak), F.lit("1"))
    assert state.advance(never, day(full), F.lit("2"))[0].first()["state_events"] == ["DETAIL_RESOLVED"]


def test_state_store(spark, tmp_path):
    snap = "struct<title:string>"
    at = lambda layout=2, **k: store.StateStore(spark, f"file://{tmp_path}/state", snap, layout, **k)
    assert at().load().count() == 0
    rows = spark.createDataFrame([("job_1", ["a"], "1", "2", 1, ("t",))], f"{store.STATE}, last_snapshot {snap}")
    assert at(1).save(rows) == 1
    with pytest.raises(ValueError):
        at().load()
    up = at(upgrades={1: lambda s: s.withColumn("times_seen", F.col("times_seen") + 1)})
    assert up.load().first()["times_seen"] == 2 and up.save(up.load()) == 2
    (tmp_path / "state" / "layout=2" / "data" / "dead").mkdir()
    assert at().load().count() == 1 and [v for v, _ in at().versions()] == [1, 2]
    with pytest.raises(ValueError):
        at().save(rows.limit(0))
    # the rows of one day alone are written, and a writer that has read an older version is told so
    day = spark.createDataFrame([("job_2", ["b"], "3", "3", 1, ("u",)), ("job_1", ["a"], "1", "2", 9, ("not today",))], f"{store.STATE}, last_snapshot {snap}")
    assert at().save(day, "3") == 3 and {r["state_id"]: r["times_seen"] for r in at().load().collect()} == {"job_1": 2, "job_2": 1}
    with pytest.raises(Conflict):
        at().save(day, "3", base=2)
    assert at().save(day.limit(1)) == 4 and [r["state_id"] for r in at().load().collect()] == ["job_2"]
    at().prune(1)
    assert [v for v, _ in at().versions()] == [4] and at().load().count() == 1
    assert store.newest([("a", rows), ("b", rows.withColumn("last_seen", F.lit("9"))), ("c", rows.limit(0))])[0] == "b" and store.newest([]) is None


def test_reports_registry_and_config(spark):
    rows = spark.createDataFrame([("a+b", "x", "APPLY", 80, False), ("c", "y", "SKIP", 1, None), ("b", "z", "APPLY", 90, True)], "source string, title string, recommendation string, score int, ok boolean")
    assert [r["title"] for r in report.sheets(rows, {"apply": F.col("recommendation") == "APPLY"}, ["title", "none"])["apply"].collect()] == ["z", "x"]
    mine, others = report.unresolved(rows, "source", "b", F.col("ok"))
    assert [r["title"] for r in mine.collect()] == ["x"] and [r["title"] for r in others.collect()] == ["y"]
    assert json.loads(report.summary(rows, {"ok": F.col("ok")}).first()["json"]) == {"ok": 1, "total": 3}
    assert one(spark, engine.call("text.normalize", F.lit("Ñu"))) == "nu" and "dates.availability" in engine.FUNCTIONS
    with pytest.raises(KeyError):
        engine.call("text.nothing")
    assert engine.Config.from_env(env={"TALUS_MAX_PAGES": "3", "TALUS_STATE_DISABLED": "true", "TALUS_CAPS": "a=1,b=2", "PATH": "x"}) == engine.Config(max_pages=3, state_disabled=True, caps={"a": 1, "b": 2})
    for bad in ({"TALUS_X": "1"}, {"TALUS_WORKERS": "0"}, {"TALUS_AS_OF": "soon"}):
        with pytest.raises(ValueError):
            engine.Config.from_env(env=bad)


def test_merge_against_the_written_out_rule():
    a = {"ord": 1, "source": "A", "id": "1", "title": "t", "company": "", "location": "x", "date": "", "url": "u", "detail": "long detail", "refs": []}
    b = a | {"ord": 2, "source": "B", "company": "c", "date": "d", "detail": "longer detail", "location": ""}
    standing = dedup.Standing(1, a)
    standing.take(b)
    got = standing.record
    assert (got["detail"], got["company"], got["location"], got["date"], got["source"]) == ("longer detail", "c", "x", "d", "A+B")
    again = dedup.Standing(1, got)
    again.take(a)
    assert again.record["source"] == "A+B+A"
    same = a | {"source": "A", "id": "2", "url": ""}
    assert not dedup.same_record(a, same)
    # Once merged with B the record is no longer of the same source, so another id of A is no veto by itself.
    assert dedup.same_record(got | {"url": ""}, same | {"detail": "", "company": "c", "location": "x"})


def test_streams_restart(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2026-01-01 00:00:00"), (1, "2026-01-03 00:00:00")], "k int, t string").select("k", F.col("t").cast("timestamp").alias("t"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    once = SeenHistory(spark, f"{tmp_path}/state", "k", "t").run(stream(), f"{tmp_path}/check").collect()
    again = SeenHistory(spark, f"{tmp_path}/state", "k", "t").run(stream(), f"{tmp_path}/check").collect()
    assert once == again and once[0]["times_seen"] == 2
    counted = windowed_counts(stream(), "t", "k").writeStream.outputMode("update").format("memory").queryName("windows").trigger(availableNow=True).start()
    counted.awaitTermination()
    assert sum(r["n"] for r in spark.table("windows").collect()) == 2


def test_seen_history_merges_runs_by_level(spark, tmp_path):
    import os

    r = random.Random(2)
    batches = [[(r.choice([None, *range(6)]), r.randrange(100)) for _ in range(r.randrange(5))] for _ in range(11)]
    seen = SeenHistory(spark, f"{tmp_path}/state", "k", "t", fan=2)
    assert seen.runs(11) == [11, 10, 8] and seen.runs(8) == [8] and seen.runs(0) == []
    for n, rows in enumerate(batches):
        for _ in range(2 if n in (3, 7) else 1):  # a batch that is run again
            seen.batch(spark.createDataFrame(rows, "k int, t int"), n)
        if n in (0, 3, 6, 10):
            want = {}
            for k, t in (x for b in batches[: n + 1] for x in b):
                first, last, times = want.get(k, (t, t, 0))
                want[k] = (min(first, t), max(last, t), times + 1)
            assert {x["k"]: (x["first_seen"], x["last_seen"], x["times_seen"]) for x in seen.version(n).collect()} == want
    seen.prune()
    assert {x for x in os.listdir(f"{tmp_path}/state")} == {"v=8", "v=10", "v=11"}
    assert {x["k"] for x in seen.version(10).collect()} == want.keys()


def test_seen_history_of_an_empty_stream(spark, tmp_path):
    import os

    os.makedirs(f"{tmp_path}/in")
    stream = spark.readStream.schema("k int, t timestamp").parquet(f"{tmp_path}/in")
    got = SeenHistory(spark, f"{tmp_path}/state", "k", "t").run(stream, f"{tmp_path}/check")
    assert got.count() == 0 and got.columns == ["k", "first_seen", "last_seen", "times_seen"]


def test_publishing_again_replaces(spark, tmp_path):
    rows = spark.range(3)
    for _ in range(2):
        payloads.publish(rows, f"{tmp_path}/runs", "2026-01-01", "r1", 3)
    assert spark.read.parquet(f"{tmp_path}/runs").count() == 3


def test_contained_pairs_against_brute_force(spark):
    import random

    r = random.Random(3)
    sets = [sorted(r.sample(range(40), r.randint(1, 12))) for _ in range(80)]
    sets += [s + [99] for s in sets[:10]]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "k int, e array<int>")
    got = {(x["a"], x["b"]): x["shared"] for x in dedup.contained_pairs(df, "k", "e", 0.78).collect()}
    want = {(i, j): len(set(a) & set(b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and len(set(a) & set(b)) >= 0.78 * min(len(a), len(b))}
    assert got == want


def test_folds_of_one_character_into_several(spark):
    assert one(spark, text.normalize(F.lit("ﬁnal ½ Œuvre №5 ﬀ é"))) == "final 1 2 uvre no5 ff e"
    import unicodedata

    for c in ("ﬁ", "½", "㎏", "Ⅷ", "ǆ"):
        base = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x)).lower()
        want = " ".join("".join(x if x.isascii() and x.isalnum() else " " for x in base).split())
        assert one(spark, text.normalize(F.lit(c))) == want


def test_hashes_dates_places_and_details(spark):
    import hashlib

    words = [f"w{i % 19}" for i in range(40)]
    votes = [0] * 64
    for i in range(38):
        v = int.from_bytes(hashlib.blake2b(" ".join(words[i : i + 3]).encode(), digest_size=8).digest(), "big")
        votes = [n + (1 if v >> b & 1 else -1) for b, n in enumerate(votes)]
    want = f"{sum(1 << b for b, n in enumerate(votes) if n >= 0):016x}"
    df = spark.createDataFrame([(" ".join(words),), ("few words",), (None,)], "t string")
    assert [r[0] for r in df.select(text.simhash_blake2b("t")).collect()] == [want, "", ""]
    from talus.functions import dates, scoring

    assert [one(spark, dates.four_digit_year(F.lit(x))) for x in (" 1/2/26", "01/02/2026", "soon")] == ["01/02/2026", "01/02/2026", "soon"]
    place = lambda t: one(spark, scoring.location_points(F.lit(t), ["spain", "madrid"], r"remote.{0,30}(?:europe|eu)", r"must.{0,50}reside.{0,50}france"))
    assert [place(t) for t in ("madrid", "remote europe", "remote eu must reside in france", "remote", "paris")] == [5, 4, 1, 3, 0]
    assert one(spark, extract.detail_ok(F.lit(" x "), F.lit("CACHE"))) is True and one(spark, extract.detail_ok(F.lit("x"), F.lit(None).cast("string"))) is False
    assert one(spark, extract.without_detail_of(F.lit("d"), F.lit("Board A x"), "board a")) == ""
    card = "<div><span class='job-location x'>Here <b>&amp; there</b></span><p class=\"company\">Acme</p></div>"
    assert one(spark, extract.first_named(F.lit(card), ["organization", "company"], 220)) == "Acme" and one(spark, extract.first_named(F.lit(card), ["location"], 120)) == "Here & there"
    assert one(spark, text.query_relevant(F.lit("project officer"), "Officer of a Project", {})) is True and one(spark, text.query_relevant(F.lit("x"), "q", {"q": ["^x$"]})) is True
    snap = one(spark, state.snapshot({"title": F.lit("Ñ A"), "application_status": F.lit(" ")}, F.lit("a b c"), F.lit(True), F.lit(7), F.lit("oops")))
    assert (snap["title"], snap["application_status"], snap["score"], snap["simhash"], snap["detail_words"], snap["resolved"]) == ("n a", "UNKNOWN", None, 7, 3, True)
    with pytest.raises(ValueError):
        audit.day_spine(spark.createDataFrame([(date(2026, 1, 1),)], "d date"), "d", "2026-01-01", "2026-02-15")


@pytest.mark.parametrize("href,want", [
    ("/x?y=1", "https://e.org/x?y=1"), ("z", "https://e.org/a/z"), ("?p=2", "https://e.org/a/b?p=2"), ("//o.org/q", "https://o.org/q"), ("http://o.org", "http://o.org"), ("mailto:a@b.c", "mailto:a@b.c"), ("#t", "https://e.org/a/b#t"),
])
def test_targets_of_links(spark, href, want):
    assert one(spark, extract.absolute(F.lit(href), F.lit("https://e.org/a/b?c#d"))) == want


def test_pdf_text(spark):
    import zlib

    from talus.functions import pdf

    content = b"BT /F1 12 Tf (Call \\(2026\\)) Tj T* [(Dead) 20 (line) -300 (soon)] TJ <E9> Tj ET"
    file = b"%PDF-1.4\n1 0 obj << /Length 9 /Filter /FlateDecode >>\nstream\n" + zlib.compress(content) + b"\nendstream endobj\n2 0 obj << /Length 9 >>\nstream\nBT (plain) Tj ET\nendstream endobj\n"
    rows = spark.createDataFrame([(bytearray(file),), (bytearray(b"no pdf"),), (None,), (bytearray(b"%PDF-1.4 cut stream\nBT (x"),)], "b binary")
    assert [r[0] for r in rows.select(pdf.pdf_text("b")).collect()] == ["Call (2026) Deadline soon\u00e9 plain", "", "", ""]


def test_reference_codes_in_titles(spark):
    got = one(spark, text.reference_tokens(F.lit("hrer2026/329-159 and Ref. ab-12 x")))
    assert "HRER2026/329-159" in got and "REF.AB-12" in got


def test_contained_pairs_read_their_rows_once(spark):
    """Sets are made where rows are read; only elements that several rows have are kept to count what pairs share."""
    made = spark.sparkContext.accumulator(0)

    def some(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    sets = [(i, [100 * (i // 3) + j for j in range(20)] + [10_000 + i]) for i in range(30)]
    df = spark.createDataFrame(sets, "k long, e array<long>").mapInArrow(some, "k long, e array<long>")
    got = {(x["a"], x["b"]): x["shared"] for x in dedup.contained_pairs(df, "k", "e", 0.78).collect()}
    assert got == {(3 * i + a, 3 * i + b): 20 for i in range(10) for a, b in ((0, 1), (0, 2), (1, 2))}
    assert made.value == len(sets)
