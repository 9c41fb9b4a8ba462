"""Boards of one source: which endpoint speaks, what stays of a record, what details add."""

import json

from pyspark.sql import functions as F

from talus.functions import nested
from talus.operators import audit, views
from talus.sources import boards, collect

LINKS = {"url": lambda x: x["href"], "title": lambda x: x["title"], "search_query": lambda x: F.lit("q")}


def test_boards_details_and_watch(spark):
    link = lambda path, title: f'<a href="{path}">{title}</a>'
    rows = [
        ("new", "u", "nothing here"),
        ("old", "u", "3 offers" + link("/j/1", "One") + link("/j/2", "Two") + link("/j/3", "Watch me")),
        ("extra", "u", "9 offers" + link("/j/2", "Two, longer") + link("/j/4", "Four")),
        ("page", "u1", json.dumps({"all": [{"url": "/j/1", "place": "Here", "title": ""}, {"url": "/j/4", "place": "", "title": "Own title"}, {"url": "", "place": "x", "title": "x"}]})),
        ("table", "t", "<table><tr><td>No Link</td><td>A</td></tr><tr><td>no link </td><td>a</td></tr></table>"),
    ]
    payloads = spark.createDataFrame(rows, "source string, url string, body string")
    of = lambda name, query, **more: collect.Collector(name, collect.links("^/j/"), LINKS | {"search_query": lambda x: F.lit(query)}, declared="([0-9]+) offers", **more)
    details = collect.Collector("page", collect.objects("$.all", "struct<url:string,place:string,title:string>"), {"url": lambda x: x["url"], "title": lambda x: x["title"], "location": lambda x: x["place"]})
    table = collect.Collector("table", collect.table, {"title": collect.cell(0), "company": collect.cell(1)}, key=("title", "company"))
    spec = boards.BoardSet("S", [boards.Board("main", [of("new", "a"), of("old", "a")]), boards.Board("more", [of("extra", "b")], required=False), boards.Board("plain", [table])], details=details, watch=lambda: F.col("title").startswith("Watch"), prefix="s_")
    records, watched, said = boards.collect_boards(payloads, spec)
    got = {(r["url"], r["title"]): r for r in records.collect()}
    assert sorted((u, t.lower().strip()) for u, t in got) == [("", "no link"), ("/j/1", "one"), ("/j/2", "two, longer"), ("/j/4", "own title")]
    assert [r["url"] for r in watched.collect()] == ["/j/3"]
    assert got["/j/1", "One"]["location"] == "Here" and got["/j/2", "Two, longer"]["search_query"] == "a; b"
    assert all(r["source"] == "S" and r["id"].startswith("s_") for r in got.values()) and len({r["id"] for r in got.values()}) == 4
    diagnostics = {r["board"]: r for r in said.collect()}
    assert [(r["endpoint"], r["declared"], r["records"], r["new"], r["complete"]) for r in (diagnostics[b] for b in ("main", "more", "plain"))] == [(2, 3, 3, 3, True), (1, 9, 2, 1, False), (1, None, 2, 1, True)]
    assert all(r["source_complete"] for r in diagnostics.values())
    silent = boards.collect_boards(payloads.where("source <> 'old'"), spec)[2].collect()
    assert {r["board"]: (r["endpoint"], r["complete"], r["source_complete"]) for r in silent}["main"] == (0, False, False)
    none = boards.collect_boards(payloads.limit(0), spec)
    assert none[0].count() == 0 and none[2].count() == 3


def test_caps_for_each_employer(spark):
    cells = "".join(f"<tr><td>{i}</td><td>{c}</td></tr>" for i, c in enumerate("aababcc"))
    payloads = spark.createDataFrame([("t", "u", f"<table>{cells}</table>")], "source string, url string, body string")
    c = collect.Collector("t", collect.table, {"id": collect.cell(0), "company": collect.cell(1)}, key=("id",), most=2, per="company")
    got, said = collect.collect(payloads, c)
    assert sorted((r["id"], r["company"]) for r in got.collect()) == [("0", "a"), ("1", "a"), ("2", "b"), ("4", "b"), ("5", "c"), ("6", "c")]
    assert (said.first()["truncated"], said.first()["complete"]) == (1, False)
    assert collect.collect(payloads.limit(0), c)[1].first()["truncated"] == 0


def test_scans_stop_each_for_itself(spark):
    rows = [("A", 1, 1), ("A", 2, 2), ("A", 3, 9), ("B", 1, 9), ("B", 2, 8), ("B", 3, None), (None, 1, 1), (None, 2, 9)]
    df = spark.createDataFrame(rows, "scan string, page int, day int")
    kept = lambda **more: sorted((r["scan"] or "", r["page"]) for r in audit.cutoff(df, "page", "day", F.lit(5), **more).collect())
    assert kept(scan=["scan"]) == [("B", 1), ("B", 2), ("B", 3)]
    found = {r["scan"]: (r["first_day"], r["last_day"], r["dated"], r["undated"]) for r in audit.dated(df, ["scan"], "day").collect()}
    assert found == {"A": (1, 9, 3, 0), "B": (8, 9, 2, 1), None: (1, 9, 2, 0)}


def test_countries_and_partial_details(spark):
    rows = [("Madrid, España.", None), ("Spanish fly", "x"), ("", "in SPAIN"), (None, None), ("Spain-based", "")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r[0] for r in df.select(views.in_country(["spain", "espana"], F.col("a"), F.col("b"))).collect()] == [True, False, True, False, True]
    assert not df.select(views.in_country([], F.col("a")).alias("x")).where("x").count()
    texts = [("x" * 650, []), ("x" * 649, []), ("see the Full Offer " + "x" * 700, ["https://e.org"]), ("see the full offer " + "x" * 700, None), (None, None)]
    df = spark.createDataFrame(texts, "t string, u array<string>")
    assert [r[0] for r in df.select(nested.looks_partial(F.col("t"), F.col("u"), ["full offer"])).collect()] == [False, True, True, False, True]
