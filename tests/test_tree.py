"""The document tree and what is read from it."""

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from talus.functions import extract, tree
from talus.sources import collect


def ask(spark, *columns, **values):
    names = dict.fromkeys(values) or {"x": None}
    row = spark.createDataFrame([tuple(values.values()) or ("",)], ", ".join(f"{k} string" for k in names))
    return tuple(row.select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def text(spark, page):
    return ask(spark, extract.html_text(F.col("p")), p=page)[0]


@pytest.mark.parametrize(
    "page,want",
    [
        ("Investigaci&oacute;n &#233;tica &ndash; R&amp;D &#x41;&nbsp;z", "Investigación ética – R&D A z"),
        ("<nav>x<nav>in</nav>menu</nav>job <noscript>enable js</noscript><svg><title>icon</title></svg>", "job"),
        ("<div>a<header><div>b</div></header>c</div><footer>d", "a c"),
        ("a<script>var t = '</p><b>no';</script>b<style>p{}</style>c<!-- <p>no -->d", "a b c d"),
        ("<p>one<p>two<br>three<img src=x>four", "one two three four"),
        ("<form>a<button>b</button></form>c", "c"),
        ("<b>unclosed <i>tags</b> go on</i></u>", "unclosed tags go on"),
        ("5 < 6 & 7 > 3 &bogus; &amp", "5 < 6 & 7 > 3 &bogus; &"),
        ("  \n", ""),
        (None, ""),
    ],
)
def test_text(spark, page, want):
    assert text(spark, page) == want


def test_links_titles_and_tables(spark):
    page = """<title>A &amp; B</title><a data-href='/no' href='/yes'>1</a><a href=/x>2</a><a name=y>3</a><a href="/yes">again</a><a href="?a=1&amp;b=2">4</a>"""
    assert ask(spark, extract.html_links(F.col("p")), extract.html_title(F.col("p")), p=page) == (["/yes", "/x", "?a=1&b=2"], "A & B")
    nested = "<table><tr><th>a</th><td>b<table><tr><td>in</td></tr></table></td><td>c</td></tr><tr><td>d<td>e</table><td>stray"
    assert ask(spark, extract.table_rows(F.col("p")), p=nested)[0] == [["a", "b in", "c"], ["in"], ["d", "e"]]
    form = "<table><form><tr><td>a</td></tr></form></table>"
    assert ask(spark, extract.table_rows(F.col("p")), p=form)[0] == [["a"]]
    assert ask(spark, extract.table_rows(F.col("p")), extract.html_links(F.col("p")), extract.html_title(F.col("p")), p=None) == ([], [], "")


def test_content_and_containers(spark):
    page = "<body>Menu<header><main>no</main></header><main id=m>a<main>b</main></main><main>c</main> End</body>"
    assert ask(spark, extract.main_text(F.col("p")), p=page)[0] == "a b"
    assert ask(spark, extract.main_text(F.col("p")), p="<div>x</div><div role=main>y<nav>z</nav></div>")[0] == "y"
    block = lambda p, t, **k: ask(spark, extract.title_block(F.col("p"), F.col("t"), **k), p=p, t=t)[0]
    page = "<main><div id=all><div><section><h2>Job &eacute;</h2><p>one</p></section><p>two two two</p></div><div>other</div></div></main>"
    assert block(page, " job  É", least=8, most=10) == "Job é one"
    assert block(page, "job é", least=12, most=22) == "Job é one two two two"
    assert block(page, "job é", least=12, most=30) == "Job é one two two two other"
    assert block(page, "absent", least=1) == block(page, "", least=1) == "Job é one two two two other"


def test_elements_and_lists(spark):
    feed = "<?xml version='1.0'?><f><Position><id>1</id><name><![CDATA[A & <b>]]></name></Position><position><id>2</id><name>&#233;&lt;x</name><id>9</id></position><position>"
    kept = collect.elements("position", ("id", "name"))(F.col("p"))
    assert [tuple(x) for x in ask(spark, kept, p=feed)[0]] == [("1", "A & <b>"), ("2", "é<x"), ("", "")]
    assert ask(spark, kept, p=None)[0] == [] and ask(spark, kept, p="no xml")[0] == []
    page = "<ul><li>a <a href='/j/1'><b>One</b> &amp; all</a> Due 1<li><a href=/j/2>Two</a> Due 2</ul><a href=/help>Due</a>"
    assert [tuple(x) for x in ask(spark, collect.links("^/j/", "https://e.org")(F.col("p")), p=page)[0]] == [("https://e.org/j/1", "One & all"), ("https://e.org/j/2", "Two")]
    blocks = ask(spark, tree.over(F.col("p"), lambda n: tree.scoped(n, "^/j/", "Due", 6)), p=page)[0]
    assert [tuple(x) for x in blocks] == [("/j/1", "a One & all Due 1"), ("/j/2", "Two Due 2")]


class Plain(HTMLParser):
    """Text pieces and open elements by the plainest loop."""

    def __init__(self):
        super().__init__()
        self.open, self.out = [], []

    def handle_starttag(self, tag, attrs):
        self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if data.strip() and not set(self.open) & {"nav", "aside"}:
            self.out.append(data.strip())


def test_random_nesting_against_a_plain_loop(spark):
    r = random.Random(5)
    pages = []
    for _ in range(200):
        pages.append("".join(r.choice(["<div>", "</div>", "<nav>", "</nav>", "<b>", "</b>", "<aside>", "</aside>", " w%d " % r.randint(0, 9)]) for _ in range(r.randint(0, 40))))
    got = [x["t"] for x in spark.createDataFrame(list(enumerate(pages)), "i int, p string").select("i", extract.html_text(F.col("p")).alias("t")).orderBy("i").collect()]
    for page, t in zip(pages, got, strict=True):
        plain = Plain()
        plain.feed(page)
        plain.close()
        assert t == " ".join(" ".join(plain.out).split()), page


def test_nodes_are_a_tree(spark):
    page = "<ul><li>a<li>b<p x=1 X=2 y>c</ul>d"
    nodes = ask(spark, tree.html_nodes(F.col("p")), p=page)[0]
    assert [(n["at"], n["tag"], n["parent"], n["last"], n["text"]) for n in nodes] == [(0, "#root", -1, 8, None), (1, "ul", 0, 7, None), (2, "li", 1, 3, None), (3, "#text", 2, 3, "a"), (4, "li", 1, 7, None), (5, "#text", 4, 5, "b"), (6, "p", 4, 7, None), (7, "#text", 6, 7, "c"), (8, "#text", 0, 8, "d")]
    assert nodes[6]["attrs"] == {"x": "2", "y": ""}
    deep = "<div>" * 20_000 + "x" + "</div>" * 20_000 + "</b>" * 20_000
    assert text(spark, deep) == "x"


def test_ranked_links(spark):
    rows = [("k", "https://a.org/x.pdf", "Terms", ["data", "role"], "https://a.org/p"), ("k", "https://b.org/data-role.pdf", "", ["data", "role"], "https://a.org/p"), ("k", "https://a.org/x.pdf", "the Role", ["data", "role"], "https://a.org/p"), ("k", "https://a.org/privacy", "", None, None)]
    df = spark.createDataFrame(rows, "k string, href string, label string, words array<string>, base string")
    got = extract.rank_links(df, ["k"], "href", [(r"\.pdf", 4)], 5, "privacy", "label", "words", "base").orderBy("place").collect()
    assert [(x["href"], x["points"]) for x in got] == [("https://a.org/x.pdf", 6), ("https://b.org/data-role.pdf", 6)]


def test_pages_of_a_batch_are_handed_on_in_pieces():
    import pyarrow as pa

    pages = pa.array(["<p>a</p>" * 5000] * 9 + [None])
    pieces = list(tree.html_nodes.func(iter([pages, pages.slice(0, 0), pages])))
    assert [len(x) for x in pieces] == [2] * 4 + [2] + [2] * 4 + [2]
    assert max(len(x.flatten()) for x in pieces) <= tree.HELD + 5000 * 2 + 1
