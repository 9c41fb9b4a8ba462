"""Queries for collectors, scan control, rule engines, details, caches and SQL views, with their DuckDB counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import call, register_views
from ..functions import extract, rules, text
from ..operators import audit, cache, report, rule_table, scan
from ..operators.lineage import cut, shared_base
from ..sources import boards, collect, pages
from .queries import _NORM, _SIGNALS, _any, _query, _title


def _bodies(rows: DataFrame, source: str, by: str, item, before: str = "", after: str = "", between: str = "", most: int = 200) -> DataFrame:
    """Payloads of a source: pages of the items of most keys each, in order of their text."""
    rows = rows.withColumn(by, F.floor(F.col(by) / most))
    body = F.concat(F.lit(before), F.array_join(F.array_sort(F.collect_list(item)), between), F.lit(after))
    return rows.groupBy(by).agg(body.alias("body"), F.count("*").alias("n")).select(F.lit(source).alias("source"), F.concat(F.lit("https://e.org/"), F.col(by).cast("string")).alias("url"), F.replace("body", F.lit("{n}"), F.col("n").cast("string")).alias("body"))


def _part_links(t) -> tuple[DataFrame, collect.Collector]:
    """Parts as pages of links, some of them twice or beside links of the site."""
    link = F.concat(F.lit('<li><a class=x href="/part/'), F.col("p_partkey").cast("string"), F.lit('"><b>'), "p_name", F.lit("</b></a> <a href='/help'>Help</a> <a href=\"/part/"), F.col("p_partkey").cast("string"), F.lit('">again</a></li>'))
    payloads = _bodies(t("part").withColumn("_page", F.col("p_partkey")), "links", "_page", link, "<p>{n} offers</p><ul>", "</ul>")
    return payloads, collect.Collector("links", collect.links(r"^/part/[0-9]+$", "https://e.org"), {"url": lambda x: x["href"], "title": lambda x: x["title"]}, prefer=lambda: (F.col("title") != "again").cast("int"))


@_query("SELECT 'https://e.org/part/' || p_partkey AS url, p_name AS title FROM part")
def collect_links(t):
    return collect.collect(*_part_links(t))[0].select("url", "title")


def _customer_table(t) -> tuple[DataFrame, collect.Collector]:
    row = F.concat(F.lit("<tr><td>"), F.col("c_custkey").cast("string"), F.lit("</td><td> "), "c_name", F.lit("</td><td>"), "c_mktsegment", F.lit("</td></tr>"))
    payloads = _bodies(t("customer").withColumn("_page", F.col("c_custkey")), "table", "_page", row, "<table><tr></tr>", "</table>")
    return payloads, collect.Collector("table", collect.table, {"id": collect.cell(0), "title": collect.cell(1), "company": collect.cell(2), "location": collect.cell(7)}, keep=lambda: F.col("company") != "BUILDING", key=("id",))


@_query("SELECT c_custkey::VARCHAR AS id, c_name AS title, c_mktsegment AS company, '' AS location FROM customer WHERE c_mktsegment <> 'BUILDING'")
def collect_table(t):
    return collect.collect(*_customer_table(t))[0].select("id", "title", "company", "location")


def _supplier_json(t) -> tuple[DataFrame, collect.Collector]:
    item = F.to_json(F.struct(F.struct(F.col("s_suppkey").alias("key")).alias("ref"), F.col("s_name").alias("name"), F.array(F.lit(""), F.lit("A"), F.lit("A"), F.lit("B")).alias("places")))
    payloads = _bodies(t("supplier").withColumn("_page", F.col("s_suppkey")), "json", "_page", item, '{"total": {n}, "hits": [', "]}", ",")
    places = lambda x: F.array_join(F.array_distinct(F.filter(x["places"], lambda p: p != "")), "; ")
    schema = "struct<ref:struct<key:string>,name:string,title:string,places:array<string>>"
    fields = {"id": lambda x: x["ref"]["key"], "title": lambda x: F.coalesce(F.nullif(x["title"], F.lit("")), x["name"]), "location": places}
    return payloads, collect.Collector("json", collect.objects("$.hits", schema), fields, key=("id",), declared=r'"total": ([0-9]+)')


@_query("SELECT s_suppkey::VARCHAR AS id, s_name AS title, 'A; B' AS location FROM supplier")
def collect_json(t):
    return collect.collect(*_supplier_json(t))[0].select("id", "title", "location")


def _nation_blocks(t) -> tuple[DataFrame, collect.Collector]:
    block = F.concat(F.lit("Title: "), "n_name", F.lit("\nRef. "), F.col("n_nationkey").cast("string"), F.lit("\nPlace:  "), F.col("n_regionkey").cast("string"))
    payloads = _bodies(t("nation").withColumn("_page", F.col("n_nationkey")), "blocks", "_page", block, "Open calls\n----\n", "\n----\n", "\n----\n", 5)
    fields = {"title": collect.value("Title:"), "id": collect.value(r"Ref\."), "location": collect.value("Place:")}
    return payloads, collect.Collector("blocks", collect.blocks("(?m)^----$", ("Title:", r"Ref\.", "Place:")), fields, key=("title", "location"))


@_query("SELECT n_nationkey::VARCHAR AS id, n_name AS title, n_regionkey::VARCHAR AS location FROM nation")
def collect_blocks(t):
    return collect.collect(*_nation_blocks(t))[0].select("id", "title", "location")


def _region_feed(t) -> tuple[DataFrame, collect.Collector]:
    item = F.concat(F.lit("<position><id>"), F.col("r_regionkey").cast("string"), F.lit("</id><name><![CDATA["), "r_name", F.lit("]]></name></position>"))
    payloads = _bodies(t("region").withColumn("_page", F.col("r_regionkey")), "feed", "_page", item, "<feed><position><id></id></position>", "</feed>")
    return payloads, collect.Collector("feed", collect.elements("position", ("id", "name")), {"id": lambda x: x["id"], "title": lambda x: x["name"]}, keep=lambda: F.col("id") != "", key=("id",), most=3)


@_query("SELECT r_regionkey::VARCHAR AS id, r_name AS title FROM region ORDER BY r_regionkey LIMIT 3")
def collect_feed(t):
    return collect.collect(*_region_feed(t))[0].select("id", "title")


@_query("""SELECT 'links' AS source, (SELECT count(DISTINCT p_partkey // 200) FROM part) AS bodies, NULL::BIGINT AS declared, 2 * count(*) AS parsed, 2 * count(*) AS kept, count(*) AS "unique", 0 AS truncated, true AS complete FROM part
UNION ALL SELECT 'table', count(DISTINCT c_custkey // 200), NULL, count(*), count(*) FILTER (c_mktsegment <> 'BUILDING'), count(*) FILTER (c_mktsegment <> 'BUILDING'), 0, true FROM customer
UNION ALL SELECT 'json', count(DISTINCT s_suppkey // 200), (SELECT max(n) FROM (SELECT count(*) AS n FROM supplier GROUP BY s_suppkey // 200)), count(*), count(*), count(*), 0, true FROM supplier
UNION ALL SELECT 'blocks', count(DISTINCT n_nationkey // 5), NULL, count(*), count(*), count(*), 0, true FROM nation UNION ALL SELECT 'feed', count(DISTINCT r_regionkey // 200), NULL, count(*) + 1, count(*), count(*), count(*) - 3, false FROM region""")
def collect_diagnostics(t):
    """What five collectors of different shapes say about their scans."""
    made = [f(t) for f in (_part_links, _customer_table, _supplier_json, _nation_blocks, _region_feed)]
    payloads = made[0][0]
    for p, _ in made[1:]:
        payloads = payloads.unionByName(p)
    return collect.collect_all(cut(payloads), [c for _, c in made])[1]


@_query("SELECT source, (1 + doc_id // 200)::BIGINT AS day, doc_id + 1 AS page, sha1(text) AS body_sha1 FROM documents WHERE doc_id + 1 BETWEEN 1 AND 150 OR source IN ('src0', 'src7')")
def captured_pages(t):
    """Documents left as captured pages and read again: two sources, and the first pages of all, each by the files they need."""
    docs = t("documents").where("doc_id is not null and source is not null")
    folder = f"{shared_base(docs.sparkSession).rstrip('/')}/pages-{uuid.uuid4().hex}"
    day = F.expr("1 + doc_id div 200").cast("string")
    pages.store(docs.select("source", day.alias("day"), (F.col("doc_id") + 1).alias("page"), F.lit("").alias("url"), F.lit("").alias("fetched_at"), F.col("text").alias("body")), folder)
    pages.register(docs.sparkSession)
    read = lambda rule: docs.sparkSession.read.format("captured_pages").load(folder).where(rule)
    two, low = read("source IN ('src0', 'src7')"), read("page <= 150").where("source NOT IN ('src0', 'src7')")
    return two.unionByName(low).select("source", F.col("day").cast("long").alias("day"), "page", F.sha1("body").alias("body_sha1"))


def _board_parts(t) -> tuple[DataFrame, boards.BoardSet]:
    """Parts on two boards: one whose first endpoint is silent, one with longer titles; and details of every fifth part."""
    part, k = t("part"), F.col("p_partkey")
    address = F.concat(F.lit("/part/"), k.cast("string"))
    link = lambda title: F.concat(F.lit('<li><a href="'), address, F.lit('">'), title, F.lit("</a></li>"))
    even, third = (part.where(k % n == 0).withColumn("_page", k) for n in (2, 3))
    single = F.to_json(F.struct(F.concat(F.lit("https://e.org"), address).alias("url"), F.col("p_brand").alias("place")))
    payloads = _bodies(even, "even", "_page", link(F.col("p_name")), "<ul>", "</ul>").unionByName(_bodies(third, "third", "_page", link(F.concat("p_name", F.lit(" again"))), "<ul>", "</ul>"))
    payloads = payloads.unionByName(_bodies(part.where(k % 5 == 0).withColumn("_page", k), "single", "_page", single, '{"all": [', "]}", ","))
    fields = {"url": lambda x: x["href"], "title": lambda x: x["title"], "search_query": lambda x: F.substring_index(x["title"], " ", -1)}
    of = lambda name: collect.Collector(name, collect.links("^/part/", "https://e.org"), fields)
    details = collect.Collector("single", collect.objects("$.all", "struct<url:string,place:string>"), {"url": lambda x: x["url"], "location": lambda x: x["place"]})
    both = (boards.Board("first", (of("silent"), of("even"))), boards.Board("second", (of("third"),), required=False), boards.Board("third", (of("nothing"),), required=False))
    return cut(payloads), boards.BoardSet("parts", both, details=details, watch=lambda: F.col("url").endswith("7"), prefix="p_")


_BOARDS = """WITH p AS (SELECT p_partkey AS k, 'https://e.org/part/' || p_partkey AS url, p_partkey % 2 = 0 AS one, p_partkey % 3 = 0 AS two, p_name, regexp_extract(p_name, '[^ ]*$') AS word, p_brand FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0)
"""


@_query(_BOARDS + """SELECT url, CASE WHEN two THEN p_name || ' again' ELSE p_name END AS title, CASE WHEN k % 5 = 0 THEN p_brand ELSE '' END AS location, concat_ws('; ', CASE WHEN one THEN word END, CASE WHEN two THEN 'again' END) AS search_query, 'p_' || substr(sha1(url), 1, 16) AS id, k % 10 = 7 AS watched FROM p""")
def collect_boards(t):
    """Records of two boards, the longer title of both, with what their details add; some are only watched."""
    records, watched, _ = boards.collect_boards(*_board_parts(t))
    return records.withColumn("watched", F.lit(False)).unionByName(watched.withColumn("watched", F.lit(True))).select("url", "title", "location", "search_query", "id", "watched")


@_query(_BOARDS + """SELECT 'first' AS board, true AS required, 2 AS endpoint, count(*) FILTER (one) AS records, count(*) FILTER (one) AS new, true AS complete, true AS source_complete FROM p
UNION ALL SELECT 'second', false, 1, count(*) FILTER (two), count(*) FILTER (two AND NOT one), true, true FROM p UNION ALL SELECT 'third', false, 0, 0, 0, false, true""")
def boards_diagnostics(t):
    """What each board gave, and whether the required ones are whole."""
    return boards.collect_boards(*_board_parts(t))[2].select("board", "required", "endpoint", "records", "new", "complete", "source_complete")


_RULES = """WITH w AS (SELECT DISTINCT name AS rule, regexp_replace(name, ' ', '[^a-z]+') AS pattern FROM items WHERE name IS NOT NULL),
t AS (SELECT DISTINCT sha1(text) AS k, lower(text) AS low FROM documents WHERE text IS NOT NULL UNION SELECT sha1(name), lower(name) FROM items WHERE name IS NOT NULL)"""


@_query(_RULES + " SELECT t.k, string_agg(w.rule, ',' ORDER BY w.rule) AS rules FROM t JOIN w ON regexp_matches(t.low, w.pattern) GROUP BY t.k")
def rule_table_match(t):
    """Names of items as rules, asked of all documents and of the names themselves."""
    items = t("items").where("name IS NOT NULL").select("name").distinct()
    rules_ = items.select(F.col("name").alias("rule"), F.replace("name", F.lit(" "), F.lit("[^a-z]+")).alias("pattern"))
    texts = t("documents").where("text IS NOT NULL").select("text").unionByName(items.select(F.col("name").alias("text"))).select(F.sha1("text").alias("k"), "text").dropDuplicates(["k"])
    return rule_table.match_rules(texts, "k", "text", rules_).where("size(rules) > 0").select("k", F.array_join(F.array_sort("rules"), ",").alias("rules"))


@_query("""SELECT doc_id, regexp_matches(text, '(?s)(^|[^a-z])the([0-9]{2}|[^a-z].{0,38}[0-9]{2})') OR regexp_matches(text, '(?s)([0-9]{2}|[0-9]{2}.{0,37}[^a-z])the[^a-z]') AS near, (length(text) - length(replace(text, ',', '')))::BIGINT AS commas FROM documents WHERE text IS NOT NULL""")
def exact_windows(t):
    """Whether a word stands near a number, by exact windows around each of its matches; and the matches of a sign."""
    docs = t("documents").where("text IS NOT NULL")
    near = rules.near_exact(F.col("text"), ["(?<![a-z])the[^a-z]"], "[0-9]{2}", 40)
    return docs.select("doc_id", near.alias("near"), F.size(rules.spans(F.col("text"), ",")).cast("long").alias("commas"))


_PAGES = """WITH p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS page, event_type, value, ts::DATE AS d, event_type || '|' || floor(value)::INT AS sig FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, sig ORDER BY page) > 1 AS rep FROM p), s AS (SELECT *, CASE WHEN event_type = 'error' THEN 'error' WHEN value < 5 THEN 'empty_page' WHEN rep THEN 'repeat' WHEN d < DATE '2024-01-20' THEN 'cutoff_reached' WHEN event_type = 'purchase' THEN 'last_page' WHEN page >= 12 THEN 'configured_page_limit' END AS reason FROM r),
x AS (SELECT user_id, coalesce(min(page) FILTER (reason IS NOT NULL), max(page)) AS stop_page, arg_min(reason, page) FILTER (reason IS NOT NULL) AS stop_reason, bool_or(rep) AS repeated FROM s GROUP BY user_id) """


def _scanned(t) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    page = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id"))
    pages = t("events").select("user_id", "event_type", "value", F.to_date("ts").alias("d"), page.cast("long").alias("page"))
    kind, sig = F.col("event_type"), F.concat_ws("|", "event_type", F.floor("value").cast("string"))
    return pages, scan.stops(pages, "user_id", "page", F.when(kind == "error", kind), F.when(F.col("value") < 5, 0).otherwise(1), sig, F.col("d"), kind == "purchase", F.to_date(F.lit("2024-01-20")), 12)


@_query(_PAGES + "SELECT * FROM x")
def scan_stops(t):
    """Events of a user, the newest first, as the pages of a scan: where it stops and why."""
    return _scanned(t)[1]


@_query(_PAGES + "SELECT x.user_id, count(*) AS pages, coalesce(any_value(stop_reason) IN ('last_page', 'empty_page') AND NOT any_value(x.repeated), false) AS complete FROM s JOIN x USING (user_id) WHERE page < stop_page OR (page = stop_page AND coalesce(stop_reason, '') NOT IN ('error', 'empty_page', 'repeat')) GROUP BY x.user_id")
def scan_coverage(t):
    """Pages that each scan took in, and whether it covered its listing."""
    pages, stopped = _scanned(t)
    taken = scan.read(pages, stopped, "user_id", "page").groupBy("user_id").agg(F.count("*").alias("pages"))
    return taken.join(stopped, "user_id").select("user_id", "pages", scan.covered(F.col("stop_reason"), F.lit(0), F.col("repeated"), F.lit(True)).alias("complete"))


def _n(t) -> DataFrame:
    return t("documents").select("doc_id", text.normalize(F.col("text")).alias("n"), text.normalize(_title()).alias("title"), "n_chars", "lang")


_DEMANDS = [r"\bthe\b.{0,40}\bof\b", r"\bder\b.{0,40}\bund\b"]
_HEADS, _ENDS, _NEGATED = [r"\bit is\b", r"\bes que\b"], [r"\band\b", r"\blos\b"], [r"\bnot the\b", r"\bof the\b"]
_SOUGHT = {"by": [r"\bby\b"], "with": [r"\bwith\b"], "que": [r"\bque\b"]}
_HITS = " + ".join(f"CASE WHEN {_any('{c}', [p])} THEN 1 ELSE 0 END" for p in _SIGNALS)


@_query(_NORM + f"SELECT doc_id, {_any('n', _DEMANDS)} AND ({_HITS.format(c='n')}) >= 3 AS gap FROM n")
def experience_gap(t):
    """A demand and several signals of what it is about."""
    return _n(t).select("doc_id", rules.demanded(F.col("n"), _DEMANDS, _SIGNALS, 3).alias("gap"))


def _near_sql(c: str, a: str, b: str, chars: int) -> str:
    return f"regexp_matches({c}, '(?:{a}).{{0,{chars}}}(?:{b})|(?:{b}).{{0,{chars}}}(?:{a})')"


_PART = "regexp_extract(t, '(?:" + "|".join(f"(?:{h})" for h in _HEADS) + ")(.{0,400}?)(?:" + "|".join(f"(?:{e})" for e in _ENDS) + "|$)', 1)"


@_query(_NORM + ", t AS (SELECT doc_id, regexp_replace(n, '" + "|".join(f"(?:{x})" for x in _NEGATED) + f"', ' optional ', 'g') AS t FROM n), p AS (SELECT doc_id, t, {_PART} AS part FROM t) SELECT doc_id, part, concat_ws(',', " + ", ".join(f"CASE WHEN {_any('part', p)} OR {_near_sql('t', f'(?:{p[0]})', '(?:thereof)', 60)} THEN '{k}' END" for k, p in _SOUGHT.items()) + ") AS gaps FROM p")
def qualification_gap(t):
    """What a text demands in its section of demands, denied demands aside."""
    n = _n(t).select("doc_id", rules.without_negated(F.col("n"), _NEGATED).alias("t"))
    gaps = rules.demanded_gaps(F.col("t"), _SOUGHT, _HEADS, _ENDS, ["thereof"], 60)
    # The section is cut to 400 characters, since the counterpart's engine counts no further than 1,000.
    cut_ = rules.section(F.col("t"), _HEADS, _ENDS, 400)
    short = F.array_compact(F.array(*(F.when(rules.any_of(F.col("part"), p) | F.array_contains("gaps", k) & rules.near(F.col("t"), "|".join(f"(?:{x})" for x in p), "(?:thereof)", 60), k) for k, p in _SOUGHT.items())))
    x = n.select("doc_id", gaps.alias("gaps"), cut_.alias("part"), "t")
    return x.select("doc_id", "part", F.array_join(short, ",").alias("gaps"))


_KINDS = {"media": [r"\bby\b"], "events": [r"\bwith\b"], "press": [r"\bque\b"]}


@_query(f"WITH n AS (SELECT doc_id, trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g')) AS n, trim(regexp_replace(strip_accents(lower(split_part(text, chr(10), 1))), '[^a-z0-9]+', ' ', 'g')) AS title FROM documents), m AS (SELECT *, regexp_matches(title, '\\bthe\\b|\\bder\\b') AND NOT regexp_matches(title, '\\band\\b') AND ({_HITS.format(c='n')}) < 5 AS open, concat_ws(',', " + ", ".join(f"CASE WHEN {_any('n', p)} THEN '{k}' END" for k, p in _KINDS.items()) + ") AS found FROM n) SELECT doc_id, open AND len(string_split(found, ',')) >= 2 AS mismatch, CASE WHEN open AND len(string_split(found, ',')) >= 2 THEN found ELSE '' END AS reason FROM m")
def delivery_mismatch(t):
    m = rules.mismatch(F.col("title"), F.col("n"), r"\bthe\b|\bder\b", r"\band\b", _SIGNALS, 5, _KINDS, 2)
    return _n(t).select("doc_id", m.alias("m")).select("doc_id", "m.mismatch", "m.reason")


@_query(_NORM + ", a AS (SELECT doc_id, n, n_chars, CASE WHEN regexp_matches(n, '\\bthe\\b') THEN 'CORE' WHEN regexp_matches(n, '\\bder\\b') THEN 'DISTANT' ELSE 'UNCLEAR' END AS c FROM n), b AS (SELECT *, CASE WHEN regexp_matches(n, '\\bque\\b') AND c IN ('UNCLEAR') THEN 'ADJACENT' ELSE c END AS d FROM a), e AS (SELECT *, CASE WHEN n_chars < 500 AND d IN ('CORE', 'ADJACENT') THEN 'DISTANT' ELSE d END AS f FROM b) SELECT doc_id, CASE WHEN regexp_matches(n, '\\bund\\b') AND f IN ('DISTANT') THEN 'ADJACENT' ELSE f END AS domain FROM e")
def staged_rules(t):
    """Promotions and demotions one after the other, each on what the one before it made."""
    n = F.col("n")
    first = rules.cascade({"CORE": n.rlike(r"\bthe\b"), "DISTANT": n.rlike(r"\bder\b")}, "UNCLEAR")
    steps = [(n.rlike(r"\bque\b"), ["UNCLEAR"], "ADJACENT"), (F.col("n_chars") < 500, ["CORE", "ADJACENT"], "DISTANT"), (n.rlike(r"\bund\b"), ["DISTANT"], "ADJACENT")]
    return _n(t).select("doc_id", rules.staged(first, steps).alias("domain"))


@_query("SELECT d.doc_id, CASE WHEN quality = 1 THEN n_chars END AS score, CASE WHEN quality = 1 THEN 'APPLY' ELSE 'NEEDS_DETAIL_REVIEW' END AS recommendation FROM documents d LEFT JOIN labels USING (doc_id)")
def unscored_route(t):
    d = t("documents").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    return d.select("doc_id", rules.unscored(F.col("quality") == 1, F.col("n_chars"), F.lit("APPLY")).alias("s")).select("doc_id", "s.score", "s.recommendation")


@_query("""WITH x AS (SELECT p_partkey, p_partkey % 4 AS k, p_name AS name, list_filter(string_split(p_name, ' '), lambda w: length(w) >= 4) AS w FROM part),
y AS (SELECT *, CASE k WHEN 0 THEN name || repeat(' all offers', 60) WHEN 1 THEN 'all offers of the house' WHEN 2 THEN '' ELSE name || ' text' END AS t FROM x)
SELECT p_partkey, t <> '' AND CASE WHEN len(w) > 0 THEN NOT (contains(t, 'all offers') AND len(list_filter(w, lambda z: contains(t, z))) / len(w) < 0.5) AND NOT (length(t) < 700 AND len(w) >= 2 AND len(list_filter(w, lambda z: contains(t, z))) / len(w) < 0.4) ELSE length(t) >= 400 OR NOT contains(t, 'all offers') END AS ok FROM y""")
def detail_integrity(t):
    """Fetched texts of four kinds against the specific words of their titles."""
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    body = F.when(k == 0, F.concat(name, F.repeat(F.lit(" all offers"), 60))).when(k == 1, "all offers of the house").when(k == 2, "").otherwise(F.concat(name, F.lit(" text")))
    words = F.filter(F.split(name, " "), lambda w: F.length(w) >= 4)
    return t("part").select("p_partkey", extract.detail_matches(words, body, ["all offers"]).alias("ok"))


@_query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'FETCH_FAILED: gone' WHEN 1 THEN 'OK_PDF_ATTACHMENT' WHEN 2 THEN 'EMPTY_DETAIL' WHEN 3 THEN 'DETAIL_MISMATCH' WHEN 4 THEN 'OK_PDF' ELSE 'OK_HTML' END AS status FROM part")
def detail_status(t):
    k = F.col("p_partkey") % 6
    status = extract.detail_status(F.when(k == 4, "PDF").otherwise("HTML"), F.when(k == 0, "gone"), F.when(k == 2, "  ").otherwise(F.col("p_name")), k != 3, F.when(k == 1, "OK_PDF"))
    return t("part").select("p_partkey", status.alias("status"))


@_query("SELECT p_partkey, CASE p_partkey % 3 WHEN 2 THEN 'Menu ' || p_name || ' End' ELSE p_name END AS body FROM part")
def main_content(t):
    """The content of pages that mark it in three ways, or not at all."""
    k, name = F.col("p_partkey") % 3, F.col("p_name")
    page = F.when(k == 0, F.concat(F.lit("<body>Menu <MAIN id=m><p>"), name, F.lit("</p><nav>x</nav></main> End</body>"))).when(k == 1, F.concat(F.lit("<body>Menu <article>"), name, F.lit("</article> End</body>"))).otherwise(F.concat(F.lit("<html><body>Menu <div>"), name, F.lit("</div> End<footer>f</footer></body></html>")))
    return t("part").select("p_partkey", extract.main_text(page).alias("body"))


@_query("""WITH c AS (SELECT user_id, event_id, event_type, date_diff('day', ts::DATE, DATE '2024-01-30') AS age FROM events), b AS (SELECT user_id, event_type, min(age) AS age FROM c WHERE age BETWEEN 0 AND 10 GROUP BY 1, 2), m AS (SELECT b.user_id, b.event_type, min(event_id) AS event_id FROM b JOIN c USING (user_id, event_type, age) GROUP BY 1, 2),
r AS (SELECT DISTINCT user_id, event_type FROM events) SELECT r.user_id, r.event_type, m.event_id AS cached FROM r LEFT JOIN m USING (user_id, event_type)""")
def cache_guarded(t):
    """The youngest entry of a key whose guard agrees, within an age limit; a key never repeats a row."""
    age = F.datediff(F.to_date(F.lit("2024-01-30")), F.to_date("ts"))
    return cache.guarded_lookup(t("events").select("user_id", "event_type").distinct(), t("events"), "user_id", ["event_type"], "event_id", age, 10)


@_query("WITH k AS (SELECT DISTINCT user_id FROM events), a AS (SELECT user_id, min(event_id) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1), b AS (SELECT user_id, max(event_id) AS v FROM events WHERE value > 50 GROUP BY 1) SELECT user_id, coalesce(a.v, b.v) AS event_id, CASE WHEN a.v IS NOT NULL THEN 1 WHEN b.v IS NOT NULL THEN 2 ELSE 0 END AS from_cache FROM k LEFT JOIN a USING (user_id) LEFT JOIN b USING (user_id)")
def cache_prefill(t):
    e = t("events")
    caches = [e.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("event_id").alias("event_id")), e.where("value > 50").groupBy("user_id").agg(F.max("event_id").alias("event_id"))]
    return cache.prefill(e.select("user_id").distinct(), "user_id", caches, "event_id")


_SHARED = "WITH e AS (SELECT DISTINCT sha1(text) AS k, source FROM documents), o AS (SELECT a.source AS source, b.source AS other, count(*) AS n FROM e a JOIN e b ON a.k = b.k AND a.source <> b.source GROUP BY 1, 2) "


@_query(_SHARED + "SELECT source, string_agg(other || '=' || n, ',' ORDER BY other) AS partners FROM o GROUP BY source")
def partner_maps(t):
    """For each source, how many texts it shares with each other one."""
    rows = t("documents").groupBy(F.sha1("text").alias("k")).agg(F.collect_set("source").alias("sources"))
    pairs = F.transform(F.map_entries("partners"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string")))
    return audit.partners(rows, "sources").select("source", F.array_join(pairs, ",").alias("partners"))


@_query("SELECT coalesce(r.source, c.source) AS source, coalesce(total, 0) AS total FROM (SELECT source, count(*) AS total FROM (SELECT DISTINCT sha1(text) AS k, source FROM documents) GROUP BY source) r FULL JOIN (VALUES ('src0'), ('nowhere')) c(source) ON r.source = c.source")
def contribution_configured(t):
    """Sources without records keep a row of zeros."""
    rows = t("documents").groupBy(F.sha1("text").alias("k")).agg(F.collect_set("source").alias("sources"))
    configured = t("documents").sparkSession.createDataFrame([("src0",), ("nowhere",)], "source string")
    return audit.contribution(rows, "sources", F.lit(False), configured).select("source", "total")


@_query("SELECT source, count(*) FILTER (lang = 'en') AS english, count(*) FILTER (n_chars > 2000) AS long, count(*) FILTER (n_chars > 2000 AND lang = 'en') AS \"both\" FROM documents GROUP BY source")
def source_measures(t):
    english, long_ = F.col("lang") == "en", F.col("n_chars") > 2000
    return audit.measured(t("documents"), "source", {"english": english, "long": long_, "both": english & long_})


@_query("WITH e AS (SELECT DISTINCT sha1(text) AS k, source FROM documents) SELECT a.source AS a, b.source AS b, count(*) AS n, 0 AS actionable FROM e a JOIN e b ON a.k = b.k AND a.source < b.source GROUP BY 1, 2 ORDER BY n DESC, a, b LIMIT 5")
def overlap_top(t):
    """The five pairs of sources that share most texts."""
    rows = t("documents").groupBy(F.sha1("text").alias("k")).agg(F.collect_set("source").alias("sources"))
    return audit.largest_overlaps(audit.overlap(rows, "sources", F.lit(False)), 5)


_REPORT = "SELECT o_orderpriority, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS closed, max(o_totalprice) AS dearest FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING' GROUP BY o_orderpriority"


@_query(_REPORT)
def sql_views(t):
    """The same SQL text, asked of Spark over registered views."""
    register_views(t("orders").sparkSession, {n: t(n) for n in ("orders", "customer")})
    return t("orders").sparkSession.sql(_REPORT)


@_query("SELECT doc_id, trim(regexp_replace(strip_accents(lower(split_part(text, chr(10), 1))), '[^a-z0-9]+', ' ', 'g')) AS title FROM documents")
def function_registry(t):
    return t("documents").select("doc_id", call("text.normalize", _title()).alias("title"))


@_query("SELECT view, count(*) AS n FROM (SELECT CASE WHEN source = 'src0' THEN 'named' ELSE 'others' END AS view FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(quality, 0) <> 1) GROUP BY view")
def report_partition(t):
    d = t("documents").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    mine, others = report.unresolved(d, "source", "src0", F.col("quality") == 1)
    return mine.select(F.lit("named").alias("view")).unionByName(others.select(F.lit("others").alias("view"))).groupBy("view").agg(F.count("*").alias("n"))


@_query("SELECT '{\"english\":' || count(*) FILTER (lang = 'en') || ',\"long\":' || count(*) FILTER (n_chars > 2000) || ',\"total\":' || count(*) || '}' AS json FROM documents")
def summary_json(t):
    return report.summary(t("documents"), {"long": F.col("n_chars") > 2000, "english": F.col("lang") == "en"})
