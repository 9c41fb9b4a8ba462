"""Dates in text, deadlines and availability as of a day."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, once

#: Month names in English, Spanish and Catalan; three letters are enough where they are unambiguous.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8, "septiembre": 9, "setiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12,
    "gener": 1, "febrer": 2, "març": 3, "maig": 5, "juny": 6, "juliol": 7, "agost": 8, "setembre": 9, "novembre": 11, "desembre": 12,
}
_NAME = "[a-záéíóúñçü]+"
_NUMERIC = r"[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}|[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
_DAY_FIRST = rf"[0-9]{{1,2}}(?:st|nd|rd|th)?(?:\s+de|\s+d')?\s*{_NAME}(?:\s+de|\s+del)?,?\s+[0-9]{{4}}"
_MONTH_FIRST = rf"{_NAME}\s+[0-9]{{1,2}}(?:st|nd|rd|th)?,?\s+[0-9]{{4}}"
TOKEN = f"(?:{_NUMERIC}|{_DAY_FIRST}|{_MONTH_FIRST})"
_ANY_CASE = "(?isu)"
#: Plain words that announce a deadline, and those that stand before its date. A form's words come first, then
#: so many characters at most, then one of the joins, then the date.
#: Words after which a colon or dash must follow, and words after which it may.
MARKED = ("close", "closes", "deadline", "deadline for application", "deadline for applications", "deadline to apply", "deadline for submission")
NAMED = ("application deadline", "application deadline is", "closing date", "closing deadline")
#: (words, characters between, joins): the joins are words, or a colon.
LOOSE = (
    (("deadline",), 90, ("by", "is", "until", ":")),
    (("how to apply", "application", "applications"), 120, ("until",)),
)
SENT = (
    ("submit application", "submit applications", "submit your application", "submit your applications", "receipt of applications")
    + tuple(f"{who}{will} {how}" for who in ("application", "applications") for will in ("", " will be") for how in ("accepted", "received", "open")),
    100,
    ("by", "until", "through"),
)
SPANISH = (
    (("fecha límite", "plazo de presentación", "fecha fin de inscripción", "fin del plazo de presentación de solicitudes"), 100, ()),
    (("plazo de solicitud",), 80, ("al", "hasta")),
)
CATALAN = ((("termini de recepció de candidatures", "termini de presentació"), 100, ()),)
#: Words that say the same without a date: closed, and open for as long as nobody is found.
CLOSED_WORDS = ("plazo de solicitud cerrado", "estado cerrado", "estado closed", "estado en subsanación", "termini tancat", "termini de sol·licitud tancat", "application closed", "applications closed")
ROLLING_WORDS = (("application", "applications", "receipt of applications"), 80, ("until a candidate is selected", "until the position is filled", "rolling basis"))
ROLLING_WHOLE = tuple(f"open until {one}candidate is {end}" for one in ("", "a ", "suitable ", "a suitable ") for end in ("selected", "found"))
#: Letters that are written with or without a mark.
_MARKS = {"a": "aàá", "e": "eèé", "i": "iíï", "o": "oòó", "u": "uúü", "c": "cç", "n": "nñ"}
_PLAIN = {x: k for k, v in _MARKS.items() for x in v}


def _words(phrases: tuple[str, ...], colon: str = "") -> str:
    """A pattern for any of the phrases: marks on letters and the amount of white space do not matter; after the first word of
    those that begin with the word colon a colon may stand. Longer phrases are asked first."""

    def one(word: str) -> str:
        letters = (_PLAIN.get(x, x) for x in word)
        return "".join(f"[{_MARKS[x]}]" if x in _MARKS else "[·.]" if x == "·" else re.escape(x) for x in letters)

    def whole(phrase: str) -> str:
        first, *rest = phrase.split()
        after = r"\s*:?" if first == colon else ""
        return r"\s+".join([one(first) + after, *map(one, rest)])

    return "(?:" + "|".join(map(whole, sorted(phrases, key=lambda x: (-len(x), x)))) + ")"


def _form(phrases: tuple[str, ...], within: int = 0, joins: tuple[str, ...] = (), sign: str = "") -> str:
    """A form up to its date: the phrases, at most so many characters, a join or a sign."""
    words = tuple(j for j in joins if j.isalpha())
    ends = [rf"\b{_words(words)}"] * bool(words) + [re.escape(j) for j in joins if not j.isalpha()]
    between = f".{{0,{within}}}?" if within else ""
    return _words(phrases) + between + (f"(?:{'|'.join(ends)})" if ends else sign) + r"\s*"


def _searches() -> tuple[str, ...]:
    """Three patterns that each find the forms at every place where one begins.

    A form is looked for ahead of each word, so what one form takes is not lost to the next. Forms that can begin at the same
    word are in different patterns, or in one where the tighter form comes first and leads to the same date.
    """
    tight = [_form(NAMED, sign=r"\s*[:-]?"), _form(MARKED, sign=r"\s*[:-]")]
    near = [_form(*f) for f in (*SPANISH, *CATALAN)]
    groups = ([*tight, *near], [_form(*f) for f in LOOSE], [_form(*SENT)])
    return tuple(rf"{_ANY_CASE}\b(?=((?:{'|'.join(g)}){TOKEN}))" for g in groups)


def _month(name: Column) -> Column:
    """The number of a month's name, of its first three letters if these are those of one month only."""
    short: dict[str, set[int]] = {}
    for k, v in MONTHS.items():
        short.setdefault(k[:3], set()).add(v)
    known = MONTHS | {k: v.copy().pop() for k, v in short.items() if len(v) == 1}
    of = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    return F.coalesce(F.try_element_at(of, name), F.try_element_at(of, F.substring(name, 1, 3)))


def parse_date(token: Column, as_of: Column) -> Column:
    """A date token as a date; null if it is none or its year is not within one before and three after as_of's.

    Commas, the letters of ordinals, "de" and repeated white space do not matter.
    """
    t = F.regexp_replace(F.lower(F.trim(blank(token))), r"([0-9])(?:st|nd|rd|th)\b|,", "$1 ")
    t = F.trim(F.regexp_replace(t, r"(?:(?<=\s)(?:del?\s|d')|\s)+", " "))
    numeric = F.regexp_extract(t, r"^([0-9]{1,2})([./-])[0-9]{1,2}\2[0-9]{4}$", 0)
    parts = F.when(t.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.split(t, "-")).when(numeric != "", F.reverse(F.split(t, "[./-]")))
    words = F.split(t, " ")
    day_first, month_first = t.rlike(f"^[0-9]{{1,2}} {_NAME} [0-9]{{4}}$"), t.rlike(f"^{_NAME} [0-9]{{1,2}} [0-9]{{4}}$")
    named = lambda m, d: F.array(F.get(words, F.lit(2)), _month(F.get(words, F.lit(m))).cast("string"), F.get(words, F.lit(d)))
    parts = F.coalesce(parts, F.when(day_first, named(1, 0)), F.when(month_first, named(0, 1)))
    value = F.try_to_date(F.array_join(F.transform(parts, lambda x: F.when(F.length(x) == 1, F.concat(F.lit("0"), x)).otherwise(x)), "-"), "yyyy-MM-dd")
    return F.when(F.year(value).between(F.year(as_of) - 1, F.year(as_of) + 3), value)


def deadline_candidates(text: Column, as_of: Column, searches: tuple[str, ...] | None = None) -> Column:
    """array<struct<date, evidence>>: dates that stand where a form says that a deadline stands, each date and evidence once,
    whatever the case of the evidence's letters. searches: patterns whose first group ends in the date."""
    found = [F.regexp_extract_all(blank(text), F.lit(p), F.lit(1)) for p in searches or _searches()]
    last = lambda h: F.regexp_extract(h, f"{_ANY_CASE}(?<![a-záéíóúñ0-9])({TOKEN})$", 1)
    dated = F.transform(F.flatten(F.array(*found)), lambda h: F.struct(parse_date(last(h), as_of).alias("date"), F.substring(F.trim(F.regexp_replace(h, r"\s+", " ")), 1, 180).alias("evidence")))
    seen = lambda x: F.struct(x["date"], F.lower(x["evidence"]))
    valid = F.filter(dated, lambda x: x["date"].isNotNull())
    return once(valid, lambda v: F.filter(v, lambda x, i: ~F.exists(F.slice(v, F.lit(1), i), lambda y: seen(y) == seen(x))))


def availability(text: Column, as_of: Column, board_date: Column | None = None, active: Column | None = None) -> Column:
    """struct<status, deadline, conflict, candidates, evidence, as_of>.

    The earliest explicit deadline decides; else closing words; else rolling words; else the source's active flag; else
    UNKNOWN. Deadlines conflict if there are several dates. evidence is what the text says, or where the date is from. The
    candidates are bound to one variable, so that the text is searched once.
    """
    found = deadline_candidates(text, as_of)
    if board_date is not None:
        found = F.concat(found, F.filter(F.array(F.struct(board_date.alias("date"), F.lit("board date").alias("evidence"))), lambda x: x["date"].isNotNull()))
    closed, rolling = rf"\b{_words(CLOSED_WORDS, 'estado')}\b", f"(?:{_form(*ROLLING_WORDS[:2])}{_words(ROLLING_WORDS[2])}|{_words(ROLLING_WHOLE)})"
    said = lambda p: F.regexp_extract(blank(text), f"{_ANY_CASE}{p}", 0)
    active = F.lit(False) if active is None else F.coalesce(active, F.lit(False))

    def of(c: Column) -> Column:
        days = F.array_sort(F.array_distinct(F.transform(c, lambda x: x["date"])))
        first = F.try_element_at(days, F.lit(1))
        status = F.when(F.size(c) > 0, F.when(first >= as_of, "OPEN").otherwise("CLOSED")).when(said(closed) != "", "CLOSED").when(said(rolling) != "", "OPEN_UNTIL_FILLED").when(active, "OPEN").otherwise("UNKNOWN")
        evidence = F.when(F.size(c) > 0, F.try_element_at(F.transform(F.filter(c, lambda x: x["date"] == first), lambda x: x["evidence"]), F.lit(1)))
        evidence = evidence.when(said(closed) != "", said(closed)).when(said(rolling) != "", said(rolling)).when(active, "listed as active").otherwise("")
        return F.struct(
            status.alias("status"), F.coalesce(F.date_format(first, "yyyy-MM-dd"), F.lit("")).alias("deadline"), (F.size(days) > 1).alias("conflict"),
            F.transform(days, lambda d: F.date_format(d, "yyyy-MM-dd")).alias("candidates"), evidence.alias("evidence"), F.date_format(as_of, "yyyy-MM-dd").alias("as_of"),
        )

    return F.get(F.transform(F.array(found), of), F.lit(0))


def four_digit_year(c: Column) -> Column:
    """A date like 1/2/26 with two digits a part and a year of four; anything else stays as it is, without blanks around."""
    t, p = F.trim(F.regexp_replace(blank(c), r"\s+", " ")), r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{2}|[0-9]{4})$"
    d, m, y = (F.regexp_extract(t, p, k) for k in (1, 2, 3))
    return F.when(t.rlike(p), F.concat_ws("/", F.lpad(d, 2, "0"), F.lpad(m, 2, "0"), F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y))).otherwise(t)


def override_unknown(status: Column, source_status: Column) -> Column:
    """The source's own word counts only where nothing else is known."""
    return F.when(status == "UNKNOWN", F.coalesce(source_status, status)).otherwise(status)
