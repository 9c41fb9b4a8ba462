"""Rule tables compiled to column expressions: label -> patterns, in the order of the labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

Rules = Mapping[str, Sequence[str]]


def any_of(text: Column, patterns: Sequence[str]) -> Column:
    """One alternation a label, so that a text is searched once for it."""
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def matched_labels(text: Column, rules: Rules) -> Column:
    """Labels that match, in the order of the table."""
    return F.array_compact(F.array(*(F.when(any_of(text, p), F.lit(label)) for label, p in rules.items())))


def first_label(text: Column, rules: Rules, otherwise: str) -> Column:
    """The first label that matches."""
    out = None
    for label, patterns in rules.items():
        out = (out.when if out is not None else F.when)(any_of(text, patterns), label)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def without_noise(text: Column, patterns: Sequence[str]) -> Column:
    """Noise removed pattern by pattern, in order; each becomes a space."""
    for p in patterns:
        text = F.regexp_replace(text, p, " ")
    return F.trim(F.regexp_replace(text, " +", " "))


def cluster(text: Column, patterns: Sequence[str], least: int) -> Column:
    """At least so many of the patterns match."""
    return sum((F.when(text.rlike(p), 1).otherwise(0) for p in patterns), F.lit(0)) >= least


def near(text: Column, pattern: str, marker: str, chars: int = 160) -> Column:
    """Pattern and marker within so many characters, in either order. Texts without the marker are not looked at further."""
    return text.rlike(f"(?:{marker})") & text.rlike(f"(?:{pattern}).{{0,{chars}}}(?:{marker})|(?:{marker}).{{0,{chars}}}(?:{pattern})")


def in_one_sentence(text: Column, *patterns: str) -> Column:
    """Some sentence matches all patterns."""

    def whole(s: Column) -> Column:
        out = F.lit(True)
        for p in patterns:
            out = out & s.rlike(p)
        return out

    return F.exists(F.split(text, "[\n.;]+"), whole)


def blockers(text: Column, rules: Rules) -> Column:
    """Labels that match, sorted and distinct."""
    return F.array_sort(F.array_distinct(matched_labels(text, rules)))


def cascade(first: Mapping[str, Column], otherwise: str) -> Column:
    """The first name whose condition holds."""
    out = None
    for name, condition in first.items():
        out = (out.when if out is not None else F.when)(F.coalesce(condition, F.lit(False)), name)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def hits(text: Column, patterns: Sequence[str]) -> Column:
    """How many of the patterns match."""
    return sum((F.when(text.rlike(p), 1).otherwise(0) for p in patterns), F.lit(0))


def demanded(text: Column, demands: Sequence[str], signals: Sequence[str], least: int) -> Column:
    """A demand is stated, and at least so many signals of what it is about are there: neither alone is a gap."""
    return any_of(text, demands) & (hits(text, signals) >= least)


def without_negated(text: Column, negations: Sequence[str], instead: str = " optional ") -> Column:
    """The text with phrases that deny a demand ("not required") replaced, so that their words are no demand."""
    return F.regexp_replace(text, "|".join(f"(?:{n})" for n in negations), instead)


def section(text: Column, headings: Sequence[str], ends: Sequence[str], most: int = 1400) -> Column:
    """What follows the first of the headings, up to one of the ends, the text's end, or most characters; else empty."""
    start, stop = ("|".join(f"(?:{x})" for x in xs) for xs in (headings, ends))
    return F.regexp_extract(text, f"(?s)(?:{start})(.{{0,{most}}}?)(?=(?:{stop})|$)", 1)


def qualification_gaps(text: Column, rules: Rules, negations: Sequence[str], headings: Sequence[str], ends: Sequence[str], markers: Sequence[str], chars: int = 160) -> Column:
    """Labels whose patterns stand in the section of what is demanded, or near a marker of demand, negated demands aside."""
    return once(without_negated(text, negations), lambda t: demanded_gaps(t, rules, headings, ends, markers, chars))


def demanded_gaps(text: Column, rules: Rules, headings: Sequence[str], ends: Sequence[str], markers: Sequence[str], chars: int = 160) -> Column:
    """qualification_gaps() of a text that is without negated demands."""
    demand = "|".join(f"(?:{m})" for m in markers)
    found = lambda part, label, p: F.when(any_of(part, p) | near(text, "|".join(f"(?:{x})" for x in p), demand, chars), F.lit(label))
    return once(section(text, headings, ends), lambda part: F.array_compact(F.array(*(found(part, label, p) for label, p in rules.items()))))


def mismatch(title: Column, text: Column, generic: str, exempt: str, duties: Sequence[str], exempting: int, signals: Rules, least: int) -> Column:
    """struct<mismatch, reason>: a generic title, not exempted by its own words or by so many duties of the text, whose text
    shows at least so many signals of another kind of work. reason names them, comma-joined."""
    found = matched_labels(text, signals)
    wrong = title.rlike(generic) & ~title.rlike(exempt) & (hits(text, duties) < exempting) & (F.size(found) >= least)
    return F.struct(wrong.alias("mismatch"), F.when(wrong, F.array_join(found, ",")).otherwise("").alias("reason"))


def staged(current: Column, steps: Sequence[tuple[Column, Sequence[str] | None, str]]) -> Column:
    """Promotions and demotions in order: (condition, from which values, or None for any, to which). Each step sees what the
    one before it made; the value is bound once a step, so long chains stay small."""

    def step(held: Column, of: Sequence[str] | None, to: str):
        return lambda c: F.when(held & (F.lit(True) if of is None else c.isin(*of)), to).otherwise(c)

    for condition, of, to in steps:
        current = once(current, step(F.coalesce(condition, F.lit(False)), of, to))
    return current


def unscored(detail_ok: Column, score: Column, recommendation: Column) -> Column:
    """struct<score, recommendation>: records without a resolved detail are not scored but wait for a review."""
    ok = F.coalesce(detail_ok, F.lit(False))
    return F.struct(F.when(ok, score).alias("score"), F.when(ok, recommendation).otherwise("NEEDS_DETAIL_REVIEW").alias("recommendation"))


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end>>: where a pattern matches, from 0, the end left out; matches do not overlap."""

    def of(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        between = F.split(t, pattern, -1)
        state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("out"))

        def step(a: Column, x: Column) -> Column:
            start = a["at"] + F.length(x["between"])
            end = start + F.length(x["found"])
            return F.struct(end.alias("at"), F.array_append(a["out"], F.struct(start.alias("start"), end.alias("end"))).alias("out"))

        pairs = F.zip_with(found, between, lambda f, b: F.struct(f.alias("found"), b.alias("between")))
        return F.aggregate(F.filter(pairs, lambda x: x["found"].isNotNull()), state, step, lambda a: a["out"])

    return once(F.coalesce(text, F.lit("")), of)


def near_exact(text: Column, patterns: Sequence[str], marker: str, chars: int = 160) -> Column:
    """Around some match of one of the patterns, so many characters to either side, the marker matches as a whole.

    Every match is looked at, and the marker sees its window alone, as if that were the text.
    """

    def around(t: Column, p: str) -> Column:
        first = lambda s: F.greatest(s["start"] - chars, F.lit(0))
        return F.exists(spans(t, p), lambda s: F.substring(t, first(s) + 1, s["end"] + chars - first(s)).rlike(marker))

    def of(t: Column) -> Column:
        out = F.lit(False)
        for p in patterns:
            out = out | around(t, p)
        return out

    return once(F.coalesce(text, F.lit("")), of)


def clustered_gaps(text: Column, groups: Rules, thresholds: Mapping[str, int], least: int = 3, context: Column | None = None, demand: str = "", chars: int = 160, defining: Mapping[str, str] | None = None) -> Column:
    """Labels of groups of which at least so many patterns match (thresholds by label, else least), in the order of groups.

    Where context holds (a kind of record that mentions such things in passing), a group counts only if the marker of demand
    stands near one of its matches. A label in defining also needs that pattern.
    """

    def of(t: Column) -> Column:
        found = []
        for label, patterns in groups.items():
            ok = hits(t, patterns) >= thresholds.get(label, least)
            if context is not None:
                ok = ok & (~F.coalesce(context, F.lit(False)) | near_exact(t, patterns, demand, chars))
            if label in (defining or {}):
                ok = ok & t.rlike(defining[label])
            found.append(F.when(ok, F.lit(label)))
        return F.array_compact(F.array(*found).cast("array<string>"))

    return once(F.coalesce(text, F.lit("")), of)
