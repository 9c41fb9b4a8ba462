"""A page as a column: one parse gives its nodes in document order, and everything else is built-in expressions over them.

A node tells its place (at), its parent's and the last one of its subtree, so a subtree is a slice. inside has a bit for
each of the WATCHED elements that it stands in, so leaving out whole parts of a page is a mask and not a search. Character
references are read by the full table of the standard, numeric ones included; elements that their place closes (a cell by
the next one, a list item by the next one) are closed.
"""

from __future__ import annotations

import xml.parsers.expat
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import clean_text, once

ROOT, TEXT = "#root", "#text"
#: The elements that nodes tell of whether they stand in them.
WATCHED = ("script", "style", "noscript", "svg", "header", "footer", "nav", "aside", "form", "button", "template", "table", "a", "li")
#: What is no content of a page, and what is none of a text.
GONE, CONTROLS = ("script", "style", "noscript", "svg", "header", "footer", "nav", "aside", "template"), ("form", "button")
NODES = T.ArrayType(T.StructType([*(T.StructField(c, k) for c, k in (("at", T.IntegerType()), ("tag", T.StringType()), ("parent", T.IntegerType()), ("last", T.IntegerType()), ("inside", T.LongType()), ("text", T.StringType()), ("attrs", T.MapType(T.StringType(), T.StringType()))))]))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an element's start closes, and up to where.
_CELL, _ITEM = ({"td", "th"}, {"tr", "table"}), ({"li"}, {"ul", "ol", "menu"})
_CLOSES = {"td": _CELL, "th": _CELL, "tr": ({"td", "th", "tr"}, {"table"}), "li": _ITEM, "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}


def bits(*tags: str) -> int:
    """The mask of watched elements."""
    return sum(1 << WATCHED.index(t) for t in tags)


class _Nodes:
    """The columns of all nodes of a batch of pages."""

    def __init__(self):
        self.at, self.tag, self.parent, self.last, self.inside, self.text = [], [], [], [], [], []
        self.keys, self.values, self.attrs, self.pages = [], [], [0], [0]

    def begin(self) -> None:
        self.first, self.open, self.held, self.flows = len(self.at), [], Counter(), False
        self.start(ROOT, {})

    def _add(self, tag: str, text: str | None, attrs: dict[str, str]) -> int:
        at = len(self.at) - self.first
        up = self.open[-1] if self.open else -1
        self.at.append(at), self.tag.append(tag), self.parent.append(up), self.last.append(at), self.text.append(text)
        above = self.first + up
        own = 1 << WATCHED.index(self.tag[above]) if up >= 0 and self.tag[above] in WATCHED else 0
        self.inside.append((self.inside[above] if up >= 0 else 0) | own)
        self.keys.extend(attrs), self.values.extend(attrs.values()), self.attrs.append(len(self.keys))
        return at

    def start(self, tag: str, attrs: dict[str, str], void: bool = False) -> None:
        at = self._add(tag, None, attrs)
        if not void:
            self.open.append(at)
            self.held[tag] += 1

    def data(self, text: str) -> None:
        if self.flows and self.tag[-1] == TEXT and self.parent[-1] == self.open[-1]:
            self.text[-1] += text
        else:
            self._add(TEXT, text, {})
        self.flows = True

    def close_to(self, depth: int) -> None:
        """Elements that are deeper than so many are over."""
        end = len(self.at) - self.first - 1
        while len(self.open) > depth:
            at = self.first + self.open.pop()
            self.last[at] = end
            self.held[self.tag[at]] -= 1

    def close(self, tags: set[str], within: set[str] = frozenset()) -> None:
        """The nearest open element of these is over, if it is nearer than any of within."""
        if not any(self.held[t] for t in tags):
            return
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.tag[self.first + self.open[depth]]
            if tag in tags:
                return self.close_to(depth)
            if tag in within:
                return

    def end(self) -> None:
        self.close_to(0)
        self.pages.append(len(self.at))

    def array(self) -> pa.Array:
        attrs = pa.MapArray.from_arrays(pa.array(self.attrs, pa.int32()), pa.array(self.keys, pa.string()), pa.array(self.values, pa.string()))
        ints = [pa.array(x, pa.int32()) for x in (self.at, self.parent, self.last)]
        columns = [ints[0], pa.array(self.tag, pa.string()), ints[1], ints[2], pa.array(self.inside, pa.int64()), pa.array(self.text, pa.string()), attrs]
        return pa.ListArray.from_arrays(pa.array(self.pages, pa.int32()), pa.StructArray.from_arrays(columns, ["at", "tag", "parent", "last", "inside", "text", "attrs"]))


class _Page(HTMLParser):
    def __init__(self, nodes: _Nodes):
        super().__init__(convert_charrefs=True)
        self.nodes = nodes

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES:
            closed, within = _CLOSES[tag]
            for t in ({"td", "th"}, {"tr"}) if tag == "tr" else (closed,):
                self.nodes.close(t, within)
        # a form that stands between a table and its cells holds nothing there
        between = tag == "form" and self.nodes.tag[self.nodes.first + self.nodes.open[-1]] in ("table", "tbody", "thead", "tfoot", "tr")
        self.nodes.start(tag, {k: v or "" for k, v in attrs}, tag in _VOID or between)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.nodes.open[-1] == len(self.nodes.at) - self.nodes.first - 1:  # it was opened, and its slash closes it
            self.nodes.close_to(len(self.nodes.open) - 1)

    def handle_endtag(self, tag):
        # what a cell or an item holds open does not outlive it, but its end does not reach out of its table or list
        self.nodes.close({tag}, _CLOSES[tag][1] if tag in _CLOSES else frozenset())

    def handle_data(self, data):
        self.nodes.data(data)

    def handle_comment(self, data):
        self.nodes.flows = False  # texts on either side of a comment are two


def _html(page: str, nodes: _Nodes) -> None:
    reader = _Page(nodes)
    reader.feed(page)
    reader.close()


def _xml(page: str, nodes: _Nodes) -> None:
    reader = xml.parsers.expat.ParserCreate()
    reader.buffer_text = True
    reader.StartElementHandler = lambda tag, attrs: nodes.start(tag, attrs)
    reader.EndElementHandler = lambda tag: nodes.close({tag})
    reader.CharacterDataHandler = nodes.data
    try:
        reader.Parse(page.strip().encode(), True)
    except xml.parsers.expat.ExpatError:
        pass  # what stands before the fault counts


#: Nodes that a task holds at a time; a page is not divided.
HELD = 20_000


def _parser(read: Callable[[str, _Nodes], None]) -> Callable[[Column], Column]:
    @F.arrow_udf(NODES)
    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            nodes = _Nodes()
            for page in pages:
                nodes.begin()
                read(page.as_py() or "", nodes)
                nodes.end()
                if len(nodes.at) >= HELD:
                    yield nodes.array()
                    nodes = _Nodes()
            if len(nodes.pages) > 1:
                yield nodes.array()

    return parse


#: The nodes of a page; those of a null or empty one are the root alone. A broken page has as many nodes as can be read.
html_nodes: Callable[[Column], Column] = _parser(_html)
#: The nodes of an XML document, names in their own case; CDATA is text.
xml_nodes: Callable[[Column], Column] = _parser(_xml)


def _mask(x: Column, without: int) -> Column:
    return x["inside"].bitwiseAND(F.lit(without)) == 0


def below(nodes: Column, at: Column) -> Column:
    """The nodes of a subtree, its top left out."""
    return F.slice(nodes, at + 2, F.get(nodes, at)["last"] - at)


def text_of(nodes: Column, at: Column, without: int = 0) -> Column:
    """The text of a subtree, its pieces apart by a space; what stands in elements of the mask is left out."""
    kept = F.filter(below(nodes, at), lambda x: (x["tag"] == TEXT) & _mask(x, without))
    return clean_text(F.array_join(F.transform(kept, lambda x: x["text"]), " "))


def attr(node: Column, name: str) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name))


def first(nodes: Column, rule: Callable[[Column], Column]) -> Column:
    """The first node of a rule, or null."""
    return F.get(F.filter(nodes, rule), F.lit(0))


def named(*tags: str) -> Callable[[Column], Column]:
    return lambda x: x["tag"].isin(*tags)


def content(nodes: Column) -> Column:
    """Where the content of a page begins: its main, else article, else element of that role, else body, else all."""
    gone = bits(*GONE)
    place = lambda rule: first(nodes, lambda x: rule(x) & _mask(x, gone))["at"]
    return F.coalesce(place(named("main")), place(named("article")), place(lambda x: attr(x, "role") == "main"), place(named("body")), F.lit(0))


def over(page: Column, f: Callable[[Column], Column]) -> Column:
    """f of a page's nodes, which are parsed once however often f names them."""
    return once(html_nodes(page), f)


def rows_of(nodes: Column) -> Column:
    """Cells of each table row, as array<array<string>>. The rows of a table in a cell are rows of their own, and its text is
    that of the cell too."""
    cells = lambda r: F.filter(below(nodes, r["at"]), lambda c: named("td", "th")(c) & (c["parent"] == r["at"]))
    return F.transform(F.filter(nodes, named("tr")), lambda r: F.transform(cells(r), lambda c: text_of(nodes, c["at"])))


def around(nodes: Column, root: Column, title: Column, least: int, most: int, levels: int) -> Column:
    """The place of the smallest container around a title, within levels, whose text has least to most characters; or null.

    Containers are asked in the order of the headings and blocks below root that hold the title.
    """
    gone, wanted = bits(*GONE), F.lower(clean_text(title))
    heads = F.filter(below(nodes, root), lambda x: named("h1", "h2", "h3", "div", "section")(x) & _mask(x, gone) & F.contains(F.lower(text_of(nodes, x["at"], gone)), wanted))
    state = lambda up, found: F.struct(up.cast("int").alias("up"), found.cast("int").alias("found"))

    def climb(a: Column, _: Column) -> Column:
        size = F.length(text_of(nodes, a["up"], gone))
        return F.when((a["found"] >= 0) | (a["up"] < 0), a).when(size.between(least, most), state(a["up"], a["up"])).otherwise(state(F.get(nodes, a["up"])["parent"], F.lit(-1)))

    found = F.transform(heads, lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(levels)), state(x["at"], F.lit(-1)), climb, lambda a: a["found"]))
    return F.when(wanted != "", F.get(F.filter(found, lambda i: i >= 0), F.lit(0)))


def scoped(nodes: Column, entity: str, marker: str, levels: int) -> Column:
    """array<struct<href, block>>: each link whose target matches entity, with the text of its smallest ancestor within levels
    that holds the marker and no other entity; empty if there is none."""
    is_entity = lambda x: (x["tag"] == "a") & F.coalesce(attr(x, "href").rlike(entity), F.lit(False))
    others = lambda at: F.size(F.array_distinct(F.transform(F.filter(below(nodes, at), is_entity), lambda x: attr(x, "href"))))
    state = lambda up, block: F.struct(up.cast("int").alias("up"), block.cast("string").alias("block"))

    def climb(a: Column, _: Column) -> Column:
        block = text_of(nodes, a["up"])
        over_ = (a["block"] != "") | (a["up"] < 0)
        return F.when(over_, a).when(others(a["up"]) > 1, state(F.lit(-1), F.lit(""))).when(block.rlike(marker), state(F.lit(-1), block)).otherwise(state(F.get(nodes, a["up"])["parent"], F.lit("")))

    block = lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(levels)), state(x["parent"], F.lit("")), climb, lambda a: a["block"])
    return F.transform(F.filter(nodes, is_entity), lambda x: F.struct(attr(x, "href").alias("href"), block(x).alias("block")))
