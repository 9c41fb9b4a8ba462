"""Fields from HTML, JSON and labelled text, in built-in functions; those from HTML over the nodes of a page (tree)."""

from __future__ import annotations

import html
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import tree
from .text import blank, clean_text, fold_accents

_NOT_TEXT = tree.bits(*tree.GONE, *tree.CONTROLS)


@F.pandas_udf(StringType())
def unescape(c: pd.Series) -> pd.Series:
    """Character references as the characters that they stand for, by the full table of the standard."""
    return c.map(html.unescape, na_action="ignore")


def only_references(page: Column, names: Sequence[str]) -> Column:
    """A page whose other character references, and those without a semicolon, are plain text."""
    return F.regexp_replace(page, f"&(?!(?:{'|'.join(map(re.escape, names))});)", "&amp;")


def html_title(page: Column) -> Column:
    return tree.over(page, lambda n: F.coalesce(tree.text_of(n, tree.first(n, tree.named("title"))["at"]), F.lit("")))


def html_text(page: Column) -> Column:
    """Text without comments, tags, and the parts that are not content."""
    return tree.over(page, lambda n: tree.text_of(n, F.lit(0), _NOT_TEXT))


def html_links(page: Column) -> Column:
    """Targets of links in order, each once."""
    anchors = lambda n: F.filter(n, lambda x: (x["tag"] == "a") & tree.attr(x, "href").isNotNull())
    return tree.over(page, lambda n: F.array_distinct(F.transform(anchors(n), lambda x: tree.attr(x, "href"))))


def table_rows(page: Column) -> Column:
    """Cells of each table row, as array<array<string>>."""
    return tree.over(page, tree.rows_of)


def labelled(text: Column, label: str, following: Sequence[str]) -> Column:
    """What stands between a label and the next one, or the end."""
    stop = "|".join((*following, "$"))
    return F.trim(F.regexp_extract(blank(text), f"(?is){label}\\s*(.+?)(?={stop})", 1))


def first_nonempty(json: Column, *paths: str) -> Column:
    """The first path of a JSON text with a value that is not blank; else empty."""
    return F.coalesce(*(F.nullif(F.trim(F.get_json_object(json, p)), F.lit("")) for p in paths), F.lit(""))


def json_ld(html: Column, kind: str) -> Column:
    """The first JSON-LD script that names the kind."""
    is_one = lambda x: (x["tag"] == "script") & (F.lower(F.trim(tree.attr(x, "type"))) == "application/ld+json")
    raw = lambda n, x: F.array_join(F.transform(tree.below(n, x["at"]), lambda y: y["text"]), "")
    return tree.over(html, lambda n: F.get(F.filter(F.transform(F.filter(n, is_one), lambda x: raw(n, x)), lambda s: s.rlike(f'"@type"\\s*:\\s*"{kind}"')), F.lit(0)))


def urls_in(text: Column) -> Column:
    """URLs in a text in order, each once, without closing punctuation."""
    return F.array_distinct(F.transform(F.regexp_extract_all(blank(text), F.lit("https?://[^\\s\"'<>]+"), F.lit(0)), lambda u: F.regexp_replace(u, "[.,;:)]+$", "")))


def cut_at(text: Column, markers: Sequence[str]) -> Column:
    """The text before the earliest marker."""
    at = F.array_min(F.filter(F.array(*(F.locate(m, F.lower(blank(text))) for m in markers)), lambda i: i > 0))
    return F.when(at.isNotNull(), F.trim(F.substring(text, F.lit(1), at - 1))).otherwise(blank(text))


def has_marker(text: Column, markers: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(F.lower(blank(text)), m))


def classify_status(text: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """struct<status, evidence> of the first pattern that matches; UNKNOWN and empty if none does."""
    t, status, evidence = F.lower(blank(text)), F.lit("UNKNOWN"), F.lit("")
    for name, p in reversed(patterns):
        status, evidence = F.when(t.rlike(p), name).otherwise(status), F.when(t.rlike(p), F.regexp_extract(t, f"({p})", 1)).otherwise(evidence)
    return F.struct(status.alias("status"), evidence.alias("evidence"))


def canonical_reference(c: Column) -> Column:
    """2026/21 -> 2026_021."""
    return F.concat(F.regexp_extract(c, "([0-9]{4})[/_-]([0-9]+)", 1), F.lit("_"), F.lpad(F.regexp_extract(c, "([0-9]{4})[/_-]([0-9]+)", 2), 3, "0"))


def content_integrity(title_words: Column, text: Column, shortest: int = 400, share: float = 0.5) -> Column:
    """struct<coverage, ok>: the share of the title's words that the text holds, and whether it is enough content."""
    n = F.size(title_words)
    coverage = F.when(n > 0, F.size(F.filter(title_words, lambda w: F.contains(text, w))) / n).otherwise(0.0)
    return F.struct(coverage.alias("coverage"), ((F.length(text) >= shortest) & (coverage >= share)).alias("ok"))


def detail_matches(title_words: Column, text: Column, index_markers: Sequence[str]) -> Column:
    """Whether a fetched text may be the page of a title, whose specific words are given.

    A general index of offers needs half of the words, a page of fewer than 700 characters two fifths of two words or more;
    without any such word an index needs 400 characters. Nothing is no page.
    """
    t = F.lower(clean_text(text))
    n = F.size(title_words)
    share = F.when(n > 0, F.size(F.filter(title_words, lambda w: F.contains(t, w))) / n).otherwise(1.0)
    index = has_marker(t, index_markers) if index_markers else F.lit(False)
    short = (F.length(t) < 700) & (n >= 2) & (share < 0.4)
    return (t != "") & F.when(n > 0, ~(index & (share < 0.5)) & ~short).otherwise((F.length(t) >= 400) | ~index)


def detail_status(kind: Column, failed: Column, text: Column, matches: Column, attachment: Column | None = None, shell: Column | None = None) -> Column:
    """The status of a resolved detail, from what was fetched: its body_kind(), a failure, its text, whether it matches its
    title, the status of an attachment that stood in for it, and whether the page is a mere shell around one."""
    attached = F.lit("") if attachment is None else blank(attachment)
    shell = F.lit(False) if shell is None else F.coalesce(shell, F.lit(False))
    return (
        F.when(blank(failed) != "", F.concat(F.lit("FETCH_FAILED: "), failed)).when(attached == "OK_PDF", "OK_PDF_ATTACHMENT").when(attached.startswith("OK"), "OK_ATTACHMENT")
        .when(clean_text(text) == "", "EMPTY_DETAIL").when(~F.coalesce(matches, F.lit(False)), "DETAIL_MISMATCH").when(shell, "ATTACHMENT_UNRESOLVED").when(kind == "PDF", "OK_PDF").otherwise("OK_HTML")
    )


#: Statuses of a detail that can be relied on.
RESOLVED = ("OK_HTML", "OK_PDF", "OK_PDF_ATTACHMENT", "OK_ATTACHMENT", "OK_API", "CACHE", "OK")


def detail_ok(detail: Column, status: Column) -> Column:
    """There is a detail, and its status is one of those that can be relied on."""
    return (clean_text(detail) != "") & F.coalesce(status.isin(*RESOLVED), F.lit(False))


def without_detail_of(detail: Column, source: Column, prefix: str) -> Column:
    """The detail, but empty for sources of this prefix, whose own page is the authority."""
    return F.when(F.lower(blank(source)).startswith(prefix.lower()), "").otherwise(blank(detail))


def first_named(html: Column, classes: Sequence[str], most: int, otherwise: str = "") -> Column:
    """Text of the first element one of whose classes holds a name, asked name by name, if it is not longer than most."""
    def ask(n: Column) -> Column:
        of_class = lambda c: tree.first(n, lambda x: F.contains(F.lower(tree.attr(x, "class")), F.lit(c.lower())))
        texts = [tree.text_of(n, of_class(c)["at"]) for c in classes]
        return F.coalesce(*(F.when((x != "") & (F.length(x) < most), x) for x in texts), F.lit(otherwise))

    return tree.over(html, ask)


def main_text(page: Column) -> Column:
    """The text of a page's content: the first main, else article, else element of that role, else body, else all."""
    return tree.over(page, lambda n: tree.text_of(n, tree.content(n), _NOT_TEXT))


def title_block(page: Column, title: Column, least: int = 500, most: int = 30_000, levels: int = 5) -> Column:
    """The text of the smallest container around the title, within levels, of least to most characters; that of the whole
    content where the title is not found in such a one."""
    return tree.over(page, lambda n: tree.text_of(n, F.coalesce(tree.around(n, tree.content(n), title, least, most, levels), tree.content(n)), _NOT_TEXT))


def header_split(text: Column, names: Sequence[str]) -> Column:
    """struct<place, rest>: the longest of the names that a header holds, and what comes after it."""
    place, rest = F.lit(""), F.lit("")
    for n in sorted(names, key=lambda n: (len(n), n)):  # the longest is asked first, so it is built last
        p = f"(?i)\\b({re.escape(n)})\\b"
        hit = blank(text).rlike(p)
        place = F.when(hit, F.initcap(F.regexp_extract(text, p, 1))).otherwise(place)
        rest = F.when(hit, clean_text(F.regexp_extract(text, p + "(?s)(.*)$", 2))).otherwise(rest)
    return F.struct(place.alias("place"), rest.alias("rest"))


def shown_range(text: Column) -> Column:
    """struct<first, last, total, expected> of "shown 1-10 of 53"; nulls where a page does not say."""
    p = r"(?i)shown\s+([0-9]+)\s*[-\u2013]\s*([0-9]+)\s+of\s+([0-9]+)"
    a, b, n = (F.nullif(F.regexp_extract(blank(text), p, k), F.lit("")).cast("int") for k in (1, 2, 3))
    return F.struct(a.alias("first"), b.alias("last"), n.alias("total"), F.when(b >= a, b - a + 1).when(b < a, 0).alias("expected"))


def body_kind(body: Column) -> Column:
    """PDF, HTML, EMPTY or OTHER by the first bytes."""
    head = F.coalesce(F.try_to_binary(F.hex(F.substring(body, 1, 1024)), F.lit("hex")), F.lit(b""))
    text = F.lower(F.trim(F.decode(head, "ISO-8859-1")))
    return F.when(F.length(head) == 0, "EMPTY").when(text.startswith("%pdf-"), "PDF").when(text.rlike("^(<!doctype html|<html|<head|<body|<\\?xml[^>]*>\\s*<html)") | text.rlike("<(html|body|div|p)\\b"), "HTML").otherwise("OTHER")


def absolute(href: Column, base: Column) -> Column:
    """A link's target as seen from the page at base: with a scheme it stays; without a host it is of base's site, without a
    leading slash of base's folder, and a mere query is one of base's page."""
    page, site = F.regexp_extract(base, "^([^?#]*)", 1), F.regexp_extract(base, "^([A-Za-z]+://[^/?#]+)", 1)
    folder = F.regexp_replace(page, "(?<=[^/:])/[^/]*$", "")
    near = F.when(href.startswith("/"), F.concat(site, href)).when(href.startswith("?") | href.startswith("#"), F.concat(page, href)).otherwise(F.concat(folder, F.lit("/"), href))
    return F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([A-Za-z]+:)", 1), href)).otherwise(near)


def next_page(html: Column, base: Column) -> Column:
    """The link to the next page, absolute: on the same host, and on the listing's own path if one is; null if none.

    A link is one to the next page by rel="next" or by its words; one that is disabled is none.
    """
    word = r"(?i)^(?:(?:next|more|suivant|siguiente|weiter)\b|[\u203a\u00bb]$)"
    has = lambda x, name, p: F.coalesce(tree.attr(x, name).rlike(p), F.lit(False))
    off = lambda x: has(x, "aria-disabled", "(?i)^true$") | has(x, "class", r"(?i)\bdisabled\b") | has(x, "href", "(?i)^(#|javascript:)")
    on = lambda n, x: has(x, "rel", r"(?i)\bnext\b") | has(x, "aria-label", word) | has(x, "title", word) | tree.text_of(n, x["at"]).rlike(word)
    hrefs = tree.over(html, lambda n: F.transform(F.filter(n, lambda x: (x["tag"] == "a") & tree.attr(x, "href").isNotNull() & on(n, x) & ~off(x)), lambda x: tree.attr(x, "href")))
    site = F.regexp_extract(base, "^([A-Za-z]+://[^/?#]+)", 1)
    path = lambda u: F.regexp_replace(F.regexp_extract(u, "^[A-Za-z]+://[^/?#]+([^?#]*)", 1), "/$", "")

    urls = F.filter(F.transform(hrefs, lambda h: absolute(h, base)), lambda u: F.regexp_extract(u, "^([A-Za-z]+://[^/?#]+)", 1) == site)
    return F.coalesce(F.try_element_at(F.filter(urls, lambda u: path(u) == path(base)), F.lit(1)), F.try_element_at(urls, F.lit(1)))


def identity_match(title_words: Column, company_words: Column, text: Column, cues: Sequence[str], shortest: int = 220) -> Column:
    """Whether a fetched text is about the record and not a general page of its site.

    Words of five letters or more in the title that are not the company's must be there (two, or half of them, or one of
    nine letters) beside two cues; a title without such words takes three cues and one of the company's first four words.
    """
    t, long_ = fold_accents(text), lambda w: F.filter(w, lambda x: F.length(x) >= 5)
    sig = F.array_except(F.array_distinct(long_(title_words)), long_(company_words))
    hit = F.filter(sig, lambda w: F.contains(t, w))
    n_cues = sum((F.when(t.rlike(p), 1).otherwise(0) for p in cues), F.lit(0))
    company = F.slice(long_(company_words), 1, 4)
    own = (n_cues >= 2) & ((F.size(hit) >= 2) | (F.size(hit) >= 0.5 * F.size(sig)) | F.exists(hit, lambda w: F.length(w) >= 9))
    general = (n_cues >= 3) & ((F.size(company) == 0) | F.exists(company, lambda w: F.contains(t, w)))
    return (F.length(blank(text)) >= shortest) & F.when(F.size(sig) > 0, own).otherwise(general)


def rank_links(links: DataFrame, key: Sequence[str], href: str, cues: Sequence[tuple[str, int]], most: int, excluded: str | None = None, label: str | None = None, title_words: str | None = None, base: str | None = None) -> DataFrame:
    """The most relevant links of each key: weights of the cues they match; ties by href; each link once, by its best points.

    Where they are given, a link's label is looked at with its target, each of the title's words that stands there is a point,
    and so is to be of the same host as base.
    """
    seen = F.lower(F.concat_ws(" ", *([label] if label else []), href))
    points = sum((F.when(seen.rlike(p), w).otherwise(0) for p, w in cues), F.lit(0))
    if title_words:
        points += F.size(F.filter(F.array_distinct(F.coalesce(title_words, F.array().cast("array<string>"))), lambda w: F.contains(seen, F.lower(w))))
    if base:
        host = lambda c: F.lower(F.regexp_extract(c, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
        points += (host(href) == host(base)).cast("int")
    if excluded:
        links = links.where(~seen.rlike(excluded))
    scored = links.groupBy(*key, href).agg(F.max(points).alias("points"))
    best = Window.partitionBy(*key).orderBy(F.desc("points"), href)
    return scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most)


def scoped_blocks(pages: DataFrame, key: str, html: str, marker: str, entity: str, levels: int = 6) -> DataFrame:
    """For each link whose target matches entity, the text of its smallest ancestor within levels that holds the marker and
    no other entity."""
    found = tree.over(F.col(html), lambda n: tree.scoped(n, entity, marker, levels))
    return pages.select(key, F.explode(found).alias("_x")).select(key, "_x.href", "_x.block")
