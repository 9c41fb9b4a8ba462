"""Operators on small data of their own; the registered queries are compared with DuckDB in test_queries.py."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from plain import one_fold

from talus.functions import dates, extract, nested, rules, scoring, text
from talus.operators import audit, cache, dedup, state, views
from talus.sources import payloads


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw,expected", [
    ("HTTP://WWW.Example.com:8080//a//b/?utm=1&Page=2&id=7#top", "http://example.com:8080/a/b?id=7"),
    ("example.com/x/", "https://example.com/x"),
    ("https://e.org/o/#/ver-oferta/12", "https://e.org/o/ver-oferta/12"),
    ("https://e.org/o?Offer_ID=A9&x=1", "https://e.org/o?offer_id=a9"),
    ("https://e.org?x=1", "https://e.org"),
    ("https://u:p@www.E.org/a?ID=A%2FB", "https://e.org/a?id=a%2Fb"), ("https://e.org/a?id=É", "https://e.org/a?id=%C3%A9"), ("https://e.org/a?id=%C3%a9", "https://e.org/a?id=%C3%A9"),
    ("https://e.org/a?id=x%20y", "https://e.org/a?id=x+y"), ("https://e.org/a?id=x+y", "https://e.org/a?id=x+y"), ("https://e.org/a?id=100%", "https://e.org/a?id=100%25"), ("https://e.org/a?id=%20&job_id=*~2", "https://e.org/a?job_id=%2A~2"),
    ("", ""),
    (None, ""),
])
def test_urls(spark, raw, expected):
    assert one(spark, text.canonical_url(F.lit(raw).cast("string"))) == expected


def test_normalize_is_idempotent(spark):
    once = one(spark, text.normalize(F.lit(" Ünïcode — Señor (X) 12 ")))
    assert once == "unicode senor x 12"
    assert one(spark, text.normalize(F.lit(once))) == once
    assert one(spark, text.clean_text(F.lit(None).cast("string"))) == ""


def test_containment(spark):
    a, b = F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "bcde"))
    assert one(spark, text.containment(a, b)) == pytest.approx(2 / 3)
    assert one(spark, text.containment(F.array().cast("array<string>"), b)) == 0


def test_sequence_ratio_depends_on_order_and_is_bounded(spark):
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), ("", "")], "a string, b string")
    rows = df.select(text.sequence_ratio("a", "b").alias("r"), text.bag_bound(F.col("a"), F.col("b")).alias("q")).collect()
    assert [r["r"] for r in rows] == [0.25, 0.5, 1.0]
    assert all(r["q"] >= r["r"] for r in rows)


@pytest.mark.parametrize("notice,status,deadline,conflict", [
    ("Deadline: 3 March 2026", "CLOSED", "2026-03-03", False),
    ("Closes: 2026-09-01. Closing date 05/09/2026", "OPEN", "2026-09-01", True),
    ("Fecha límite: 31 de febrero de 2026", "UNKNOWN", "", False),
    ("Deadline: 1 May 2040", "UNKNOWN", "", False),
    ("Open until a suitable candidate is found", "OPEN_UNTIL_FILLED", "", False),
    ("Applications will remain open until a candidate is selected.", "OPEN_UNTIL_FILLED", "", False),
    ("Applications closed; applications considered on a rolling basis", "CLOSED", "", False),
    ("Plazo de solicitud cerrado", "CLOSED", "", False), ("Estado: en subsanación", "CLOSED", "", False), ("Termini de sol·licitud tancat", "CLOSED", "", False),
    ("Fecha límite: 30 de agosto de 2026", "OPEN", "2026-08-30", False), ("FECHA LÍMITE  lunes, 3 setiembre 2026", "OPEN", "2026-09-03", False),
    ("Barcelona Closes: Sep 6, 2026 Research role.", "OPEN", "2026-09-06", False), ("How to apply: Until 31st August 2026", "OPEN", "2026-08-31", False),
    ("Plazo de solicitud del 20/07/2026 al 31/07/2026", "OPEN", "2026-07-31", False), ("Termini de presentació: 30/09/2026", "OPEN", "2026-09-30", False),
    ("Termini de recepció de candidatures: 5 de març de 2026", "CLOSED", "2026-03-05", False),
    ("Contract hasta el 31 de diciembre de 2026", "UNKNOWN", "", False), ("Deadline: see site. Published 01/02/2026", "UNKNOWN", "", False),
    ("Application Deadline 25 Aug 5206 - 15:00. The application deadline is 25\n August   2026 at 3 p.m.", "OPEN", "2026-08-25", False),
    ("Application Deadline 15 Sep 2026. Submission and deadline: candidates submit applications by September 3, 2026.", "OPEN", "2026-09-03", True),
    ("Application Deadline 30 Sep 2026 - 23:59 STATUS: EXPIRED", "OPEN", "2026-09-30", False), ("Deadline: Please send all papers by 30/09/2026", "OPEN", "2026-09-30", False),
    ("Deadline: 30.09-2026", "UNKNOWN", "", False), ("Research role in Spain.", "UNKNOWN", "", False),
    ("Applications open. Closes: 1 May 2026; extended until 3 June 2026", "CLOSED", "2026-05-01", True), ("Applications open until 1 July 2026. Interviews until 3 June 2026", "OPEN", "2026-07-01", False),
    ("Estado : Cerrado", "CLOSED", "", False), ("Receipt of applications on a rolling basis", "OPEN_UNTIL_FILLED", "", False), ("Fecha limite 30/09/2026, inicio 01/07/2026", "OPEN", "2026-09-30", False),
    (None, "UNKNOWN", "", False),
])
def test_availability(spark, notice, status, deadline, conflict):
    got = one(spark, dates.availability(F.lit(notice).cast("string"), F.lit(date(2026, 6, 1))))
    assert (got["status"], got["deadline"], got["conflict"]) == (status, deadline, conflict)


def test_evidence_is_told_once_whatever_its_case(spark):
    got = one(spark, dates.deadline_candidates(F.lit("DEADLINE: 3 May 2026\nDeadline: 3 May 2026 Deadline - 3 May 2026"), F.lit(date(2026, 6, 1))))
    assert [x["evidence"] for x in got] == ["DEADLINE: 3 May 2026", "Deadline - 3 May 2026"]


@pytest.mark.parametrize("points,name", [(49, "SKIP"), (50, "LOW_PRIORITY"), (64, "LOW_PRIORITY"), (65, "REVIEW"), (79, "REVIEW"), (80, "APPLY"), (89, "APPLY"), (90, "STRONG_APPLY")])
def test_buckets(spark, points, name):
    assert one(spark, scoring.bucket(F.lit(points))) == name


def test_caps_and_blockers(spark):
    caps = [(F.lit(True), 64), (F.lit(False), 10), (F.lit(True), 59)]
    assert one(spark, scoring.score([F.lit(50), F.lit(45)], caps)) == 59
    assert one(spark, scoring.score([F.lit(50)], caps, F.lit(True))) == 0


def test_rules_keep_order_and_scope(spark):
    table = {"b": ["y+"], "a": ["x"]}
    assert one(spark, rules.matched_labels(F.lit("x yy"), table)) == ["b", "a"]
    assert one(spark, rules.blockers(F.lit("x yy"), table)) == ["a", "b"]
    assert one(spark, rules.in_one_sentence(F.lit("a b. c"), "a", "b")) and not one(spark, rules.in_one_sentence(F.lit("a. b"), "a", "b"))


def test_survivors_and_first_wins(spark):
    rows = spark.createDataFrame([(1, "k", "", "A", 3), (2, "k", "x", "B", 5), (3, "k", "y", "A", 5)], "ord int, k string, company string, source string, size int")
    got = dedup.survivors(rows, "k", "ord", F.col("size"), ["ord"], ["company"], "source").first()
    assert (got["ord"], got["company"], got["sources"], got["removed"]) == (2, "x", "A+B", 2)
    assert dedup.first_wins(rows, ["k"], ["ord"]).first()["ord"] == 1


def test_greedy_resolution_equals_one_fold_over_all(spark):
    import random

    r = random.Random(4)
    words = ["research", "project", "manager", "officer", "data", "clinical", "barcelona", "trial"]
    long_ = [" ".join(r.choice(words) for _ in range(40)) for _ in range(3)]
    rows = []
    for i in range(60):
        title = " ".join(r.sample(words, 4)) if i % 3 else "research project manager data"
        title += r.choice(["", "s", ""])
        rows.append({"ord": i, "source": r.choice("ab"), "id": r.choice(["", str(i % 7)]), "title": title, "company": r.choice(["", "acme", "acmes"]), "location": r.choice(["", "madrid"]), "url": r.choice(["", "", f"https://e.org/{i % 9}"]), "detail": r.choice(["", *long_]), "refs": r.choice([[], ["AB12"], ["CD34"]])})
    df = spark.createDataFrame(rows, "ord long, source string, id string, title string, company string, location string, url string, detail string, refs array<string>")
    got = {x["ord"]: x["rep"] for x in dedup.greedy_resolution(df).collect()}
    assert got == one_fold(rows)
    small = {x["ord"]: x["rep"] for x in dedup.greedy_resolution(df, block=7).collect()}
    assert small == got  # components of several blocks are decided in rounds


def test_state_over_days(spark):
    snap = "struct<title:string,company:string,location:string,application_deadline:string,application_status:string>"
    schema = f"ord long, aliases array<struct<rank:int,alias:string>>, snapshot {snap}"
    empty = spark.createDataFrame([], f"state_id string, aliases array<string>, first_seen string, last_seen string, times_seen int, last_snapshot {snap}")
    day1 = spark.createDataFrame([(1, [(0, "id|s|1")], ("t", "c", "l", "", "OPEN")), (2, [(3, "x")], ("u", "c", "l", "", "CLOSED")), (3, [(3, "x")], ("u", "c", "l", "", "OPEN"))], schema)
    seen, s1 = state.advance(empty, day1, F.lit("d1"))
    assert {r["seen_status"] for r in seen.collect()} == {"NEW"}
    assert sorted(r["state_id"][-2:] == "_1" for r in s1.collect()) == [False, False, True]
    day2 = spark.createDataFrame([(1, [(0, "id|s|1")], ("t2", "c", "l", "", "OPEN")), (2, [(3, "x")], ("u", "c", "l", "", "OPEN"))], schema)
    seen, s2 = state.advance(s1, day2, F.lit("d2"))
    assert {r["ord"]: (r["seen_status"], r["change_reasons"]) for r in seen.collect()} == {1: ("MATERIALLY_CHANGED", ["title"]), 2: ("NEW", [])}  # x names two rows
    assert {r["last_seen"] for r in s2.collect()} == {"d1", "d2"}
    seen, s3 = state.advance(s2, day2, F.lit("d3"))
    assert next(r for r in seen.collect() if r["ord"] == 1)["seen_status"] == "SEEN"


def test_reopened_outranks_changed(spark):
    c = state.transition(F.lit(True), F.lit("CLOSED"), F.lit("OPEN"), F.array(F.lit("title")))
    assert one(spark, c) == "REOPENED"
    assert one(spark, state.transition(F.lit(True), F.lit("CLOSED"), F.lit("OPEN"), F.array().cast("array<string>"), F.lit(True))) == "SEEN"


def test_views_and_topn(spark):
    rows = spark.createDataFrame([(1, "APPLY", "OPEN", "NEW"), (2, "SKIP", "CLOSED", "SEEN"), (3, None, None, None)], "id int, r string, a string, s string")
    got = {(x["view"], x["id"]) for x in views.route(rows, views.standard_views(F.col("r"), F.col("a"), F.col("s"), F.lit(None).cast("boolean"), F.lit(None).cast("boolean")), ["id"]).collect()}
    assert ("new_actionable", 1) in got and ("closed", 2) in got and ("all_canonical", 3) in got and ("actionable", 3) not in got
    assert views.top_n(rows, [F.col("id")], 2, []).first()["truncated"] == 1


def test_audit(spark):
    rows = spark.createDataFrame([(["a", "b"], True), (["a"], False), ([], True)], "s array<string>, act boolean")
    assert {r["source"]: (r["total"], r["exclusive"]) for r in audit.contribution(rows, "s", F.col("act")).collect()} == {"a": (2, 1), "b": (1, 0)}
    assert audit.overlap(rows, "s", F.col("act")).collect()[0][:] == ("a", "b", 1, 1)
    assert audit.totals(rows, "s").first()[:] == (3, 1, 1, 1)


def test_cache(spark):
    rows = spark.createDataFrame([("k", 1, 3), ("k", 2, 1), ("k", 3, 1), ("z", 4, 9)], "k string, ord int, age int")
    assert [(r["k"], r["ord"]) for r in cache.freshest(rows, ["k"], F.col("age"), "ord", 2).collect()] == [("k", 2)]


def test_extraction(spark):
    html = "<title>A &amp; B</title><script>x</script><ul><li>Due 3 <a href='/j/1'>One</a></li><li>Due 4 <a href='/j/2'>Two</a></li></ul><table><tr><td>p</td><td>q</td></tr></table>"
    pages = spark.createDataFrame([(1, html), (2, None)], "id int, html string")
    assert pages.select(extract.html_title(F.col("html"))).first()[0] == "A & B"
    assert pages.select(extract.table_rows(F.col("html"))).first()[0] == [["p", "q"]]
    blocks = {r["href"]: r["block"] for r in extract.scoped_blocks(pages, "id", "html", "Due", "^/j/").collect()}
    assert blocks == {"/j/1": "Due 3 One", "/j/2": "Due 4 Two"}
    assert one(spark, extract.labelled(F.lit("Company: X Y Place: Z"), "Company:", ["Place:"])) == "X Y"
    assert one(spark, extract.canonical_reference(F.lit("ref 2026/21"))) == "2026_021"
    assert one(spark, extract.first_nonempty(F.lit('{"a": " ", "b": {"c": "v"}}'), "$.a", "$.b.c")) == "v"


def test_payloads(spark, tmp_path):
    rows = spark.createDataFrame([("s", "u", '{"results": [{"id": 1, "name": "n"}]}', 5)], "source string, url string, body string, extra int")
    assert payloads.json_listing(rows, "$.results", "struct<id:int,name:string>").first()["name"] == "n"
    assert payloads.records(rows).first()["extras"] == {"body": '{"results": [{"id": 1, "name": "n"}]}', "extra": "5"}
    xml = spark.createDataFrame([("s", "<feed><position><id> 7 </id><name>N</name></position></feed>")], "source string, body string")
    assert payloads.xml_feed(xml, "position", ["id", "name", "office"]).first()[:] == ("s", "7", "N", "")
    payloads.write_views(rows, {"none": F.lit(False), "all": F.lit(True)}, f"file://{tmp_path}")
    assert "extra" in next(tmp_path.joinpath("none").glob("*.csv")).read_text()
    with pytest.raises(ValueError):
        payloads.publish(rows.limit(0), f"file://{tmp_path}/p", "d", "r", 0)


def test_nested_json(spark):
    deep = '{"a":' * 3000 + "1" + "}" * 3000
    rows = spark.createDataFrame([(1, '{"dsPuesto": "x  y", "idOferta": 4, "ok": true, "list": [{"ds_nota": 1.5}, null, ""], "dspuesto": "X y"}'), (2, "{broken"), (3, None), (4, deep), (5, '"solo"')], "id int, j string")
    got = {r["id"]: r for r in rows.select("id", nested.json_leaves("j").alias("l")).select("id", "l", nested.render(F.col("l"), {"dsPuesto": "Position", "dspuesto": "Position"}).alias("r")).collect()}
    assert [x["path"] for x in got[1]["l"]] == ["dsPuesto", "idOferta", "ok", "list[0].ds_nota", "dspuesto"]
    assert got[1]["r"] == "Position: x y\nNota: 1.5" and got[2]["l"] == got[3]["l"] == [] and got[3]["r"] == ""
    assert got[5]["l"][0]["value"] == "solo" and len(got[4]["l"]) <= 1
    long_ = rows.limit(1).select(nested.json_leaves(F.lit('{"dsFunciones": "' + "f" * 50 + '", "dsPerfil": "' + "p" * 50 + '"}')).alias("l"))
    assert long_.select(nested.substantive(F.col("l"), ("dsfunciones", "dsperfil"))).first()[0] and not long_.select(nested.substantive(F.col("l"), ("dsperfil",))).first()[0]


def test_linked_data(spark):
    html = '<script type="application/ld+json">{bad</script><script type=\'application/ld+json\'>[{"x": {"@type": ["A", "jobposting"], "hiringOrganization": "Org", "jobLocation": [{"address": {"addressLocality": "L", "addressRegion": "L", "addressCountry": {"name": "C"}}}, {"address": {"addressLocality": "L", "addressCountry": "C"}}, {}]}}]</script>'
    pages = spark.createDataFrame([(html,), (None,), ("",)], "html string").select(nested.linked_object(F.col("html"), "JobPosting").alias("o"))
    got = pages.select(nested.named(F.col("o"), "hiringOrganization"), nested.places(F.col("o"))).collect()
    assert [tuple(r) for r in got] == [("Org", "L, C"), ("", ""), ("", "")]


def test_page_operators(spark):
    split = one(spark, extract.header_split(F.lit("JOB | Papua New Guinea | Org"), ["Guinea", "New Guinea", "Papua New Guinea"]))
    assert split["place"] == "Papua New Guinea" and split["rest"] == "| Org"
    assert one(spark, extract.shown_range(F.lit(None).cast("string")))["expected"] is None
    kinds = [one(spark, extract.body_kind(F.lit(b))) for b in (b"%PDF-1.7", b" <!DOCTYPE html>", b"\xff\xfe", b"")]
    assert kinds == ["PDF", "HTML", "OTHER", "EMPTY"]
    base = F.lit("https://a.org/jobs/list?p=1")
    for html, want in [("<a href='/other?p=2'>Next</a><a class='x' rel='next' href='?p=2&amp;q=1'>2</a>", "https://a.org/jobs/list?p=2&q=1"), ("<a href='https://b.org/x'>next</a>", None), ("<a class='disabled' href='?p=2'>next</a>", None), ("<a href='more.html'>\u203a</a>", "https://a.org/jobs/more.html"), ("<a href='?p=9'>nextdoor</a>", None), ("", None)]:
        assert one(spark, extract.next_page(F.lit(html), base)) == want
    assert [one(spark, text.page_url(F.lit(u))) for u in ("HTTPS://www.A.org:80/x/?q=1#Ver/7/", "a.org", "")] == ["https://a.org/x#ver/7", "https://a.org", ""]
    words = lambda *w: F.array(*map(F.lit, w)) if w else F.array().cast("array<string>")
    body = F.lit("requirements and duties for the genomics analyst position at the institute; deadline soon. " * 4)
    cues = ["requirements", "duties", "deadline"]
    assert one(spark, extract.identity_match(words("genomics", "analyst"), words("institute"), body, cues))
    assert not one(spark, extract.identity_match(words("oncology", "nurse"), words("institute"), body, cues))
    assert one(spark, extract.identity_match(words("job"), words("institute"), body, cues)) and not one(spark, extract.identity_match(words("job"), words("hospital"), body, cues))
    assert one(spark, audit.hard_error(F.lit(0), F.lit(2), F.lit(""), "all failed")) == "all failed" and one(spark, audit.hard_error(F.lit(1), F.lit(2), F.lit("w"), "x")) == ""


def test_titles_differ(spark):
    rows = spark.createDataFrame([("Data manager (m/f)", "data manager [x]"), ("Data manager", "manager data"), ("Data manager", "Oncology nurse"), ("", "x"), (None, "x")], "a string, b string")
    assert [r[0] for r in rows.select(text.titles_differ(F.col("a"), F.col("b"))).collect()] == [False, False, True, False, False]


def _state_frames(spark):
    snap = "struct<title:string,company:string,location:string,application_deadline:string,application_status:string>"
    s = f"state_id string, aliases array<string>, first_seen string, last_seen string, times_seen int, last_snapshot {snap}"
    return s, f"ord long, aliases array<struct<rank:int,alias:string>>, snapshot {snap}"


def test_state_reused_ids_and_splits(spark):
    held, given = _state_frames(spark)
    snap = lambda t: (t, "c", "l", "", "OPEN")
    s0 = spark.createDataFrame([
        ("job_a", ["id|s|1", "url|u1"], "d0", "d0", 1, snap("data manager")),
        ("job_b", ["id|s|2", "id|s|3", "url|u2", "url|u3"], "d0", "d0", 4, snap("clinical trials officer")),
        ("job_c", ["id|s|4", "url|u4", "url|u5"], "d0", "d0", 2, snap("project lead")),
    ], held)
    day = spark.createDataFrame([
        (1, [(0, "id|s|1"), (1, "url|u9")], snap("oncology nurse")),  # a source's id given to another record
        (2, [(0, "id|s|2"), (1, "url|u2")], snap("clinical trials officer")),
        (3, [(0, "id|s|3"), (1, "url|u3")], snap("library assistant")),  # two records held as one
        (4, [(0, "id|s|3"), (1, "url|u3")], snap("library assistant")),
        (5, [(0, "id|s|4"), (1, "url|u4")], snap("project lead")),
        (6, [(0, "id|s|4"), (1, "url|u5")], snap("kitchen porter")),  # one id, other URL and title, both held
    ], given)
    seen, s1 = state.advance(s0, day, F.lit("d1"))
    got = {r["ord"]: (r["state_id"], r["seen_status"], r["change_reasons"]) for r in seen.collect()}
    sid = lambda a: spark.range(1).select(state.state_id(F.lit(a))).first()[0]
    assert got[1] == (sid("url|u9"), "NEW", []) and got[2] == ("job_b", "SEEN", []) and got[5] == ("job_c", "SEEN", [])
    assert got[3] == got[4] == (sid("id|s|3"), "SEEN", []) and got[6] == (sid("url|u5"), "SEEN", [])
    now = {r["state_id"]: (r["aliases"], r["first_seen"], r["last_seen"], r["times_seen"]) for r in s1.collect()}
    assert now == {
        "job_a": (["id|s|1", "url|u1"], "d0", "d0", 1), got[1][0]: (["id|s|1", "url|u9"], "d1", "d1", 1),
        "job_b": (["id|s|2", "url|u2"], "d0", "d1", 5), got[3][0]: (["id|s|3", "url|u3"], "d0", "d1", 2),
        "job_c": (["id|s|4", "url|u4"], "d0", "d1", 3), got[6][0]: (["id|s|4", "url|u5"], "d0", "d1", 1),
    }


def test_state_ids_never_collide_and_rows_follow_each_other(spark):
    held, given = _state_frames(spark)
    snap = lambda t: (t, "c", "l", "", "OPEN")
    empty = spark.createDataFrame([], held)
    twice = spark.createDataFrame([(1, [(3, "x")], snap("u")), (2, [(3, "x")], snap("u"))], given)
    _, s1 = state.advance(empty, twice, F.lit("d1"))
    _, s2 = state.advance(s1, twice, F.lit("d2"))
    assert s2.count() == s2.select("state_id").distinct().count() == 4
    known = spark.createDataFrame([(1, [(0, "id|s|1")], snap("a")), (2, [(0, "id|s|1")], snap("b")), (3, [(0, "id|s|1")], snap("b"))], given)
    _, k1 = state.advance(empty, known.where("ord = 1"), F.lit("d1"))
    seen, k2 = state.advance(k1, known, F.lit("d2"))
    assert [(r["seen_status"], r["change_reasons"]) for r in seen.orderBy("ord").collect()] == [("SEEN", []), ("MATERIALLY_CHANGED", ["title"]), ("SEEN", [])]
    assert k2.select("times_seen", "last_snapshot.title").collect()[0][:] == (4, "b")
    with pytest.raises(ValueError):
        state.checked(k2, 9, (1, 2))


def test_ratio_prefix_loses_no_pair(spark):
    import random
    from difflib import SequenceMatcher
    from itertools import combinations

    r = random.Random(3)
    names = ["", "", "a", "a", "é", "aaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaa"]
    for _ in range(40):
        x = [r.choice("aab c1é") for _ in range(r.randint(1, 40))]
        names += ["".join(x), "".join(c for c in x if r.random() > 0.1), "".join("z" if r.random() < 0.1 else c for c in x)]
    df = spark.createDataFrame(list(enumerate(names)), "k long, s string")
    for least in (0.9, 0.96):
        keyed = text.ratio_prefix(df, ["k"], "s", least)
        a, b = keyed.alias("a"), keyed.alias("b")
        got = {tuple(x) for x in a.join(b, F.col("a._gram") == F.col("b._gram")).where("a.k < b.k").select("a.k", "b.k").distinct().collect()}
        want = {(i, j) for (i, x), (j, y) in combinations(enumerate(names), 2) if max(SequenceMatcher(None, x, y).ratio(), SequenceMatcher(None, y, x).ratio()) >= least}
        assert want and want <= got


def test_candidate_edges_lose_no_close_title(spark):
    words = [f"word{i:02}" for i in range(26)]
    changed = [f"wort{i:02}" if i in (5, 15) else w for i, w in enumerate(words)]
    body = " ".join(f"body{i}" for i in range(300))
    rows = [(1, "s", "", " ".join(words), "c", "", "", " ".join(words) + " " + body, []), (2, "t", "", " ".join(changed), "d", "", "", " ".join(changed) + " " + body, []), (3, "t", "", " ".join(changed), "d", "", "", "different " * 50, [])]
    df = spark.createDataFrame(rows, "ord long, source string, id string, title string, company string, location string, url string, detail string, refs array<string>")
    whole = one_fold([r.asDict() for r in df.collect()])
    assert whole == {1: 1, 2: 1, 3: 3}
    assert {x["ord"]: x["rep"] for x in dedup.greedy_resolution(df).collect()} == whole
