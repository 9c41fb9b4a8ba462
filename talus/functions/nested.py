"""Nested JSON: its scalar leaves, their rendering as text, and typed objects of linked data.

Depth is not bounded, so the walk itself is a vectorised function; all that follows it is built-in.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .text import blank, clean_text, fold_accents

LEAVES = ArrayType(StructType([StructField(c, StringType()) for c in ("path", "value", "kind")]))


def _walk(root) -> Iterator[tuple[str, object]]:
    """(path, value) of every value below root, itself included, parents first and in order; without recursion."""
    todo = [("", root)]
    while todo:
        path, value = todo.pop()
        yield path, value
        if isinstance(value, dict):
            todo += [(f"{path}.{k}" if path else k, v) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            todo += [(f"{path}[{i}]", value[i]) for i in range(len(value) - 1, -1, -1)]


def _parsed(text: str | None):
    try:
        return json.loads(text or "null")
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(LEAVES)
def json_leaves(text: pd.Series) -> pd.Series:
    """Scalars of a JSON text in order, with dotted paths; null and empty ones are left out, and a broken text has none."""

    def leaf(path, v):
        kind = "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "number"
        return {"path": path, "value": v if kind == "string" else json.dumps(v), "kind": kind}

    return pd.Series([[leaf(p, v) for p, v in _walk(_parsed(t)) if v not in (None, "") and not isinstance(v, (dict, list))] for t in text])


def leaf_name(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, ".", -1), r"\[[0-9]+\]", "")


def leaf_label(name: Column, labels: Mapping[str, str], prefix: str) -> Column:
    """The label given for a name, else its words: prefix off, split at capitals and underscores, first letter large."""
    words = F.trim(F.replace(F.regexp_replace(F.regexp_replace(name, prefix, ""), r"(?<!^)(?=\p{Lu})", " "), F.lit("_"), F.lit(" ")))
    out = F.when(words == "", name).otherwise(F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, F.lit(2), F.length(words))))
    for own, label in labels.items():
        out = F.when(name == own, label).otherwise(out)
    return out


def render(leaves: Column, labels: Mapping[str, str] | None = None, prefix: str = "^(ds|fc|nm|id)", opaque: str = "^id[A-Z_]", most: int = 50_000) -> Column:
    """Lines "Label: value" of the leaves: no opaque names and no booleans, equal lines once whatever their case.

    leaves must be a column that an earlier select made, since the walk can't stand inside a lambda.
    """
    kept = F.filter(leaves, lambda x: (x["kind"] != "boolean") & ~leaf_name(x["path"]).rlike(opaque) & (clean_text(x["value"]) != ""))
    lines = F.transform(kept, lambda x: F.concat(leaf_label(leaf_name(x["path"]), labels or {}, prefix), F.lit(": "), clean_text(x["value"])))
    low = F.transform(lines, F.lower)
    first = F.filter(lines, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)
    return F.substring(F.array_join(first, "\n"), 1, most)


def substantive(leaves: Column, strong: tuple[str, ...], each: int = 40, total: int = 220, body: Column | None = None, cues: tuple[str, ...] = (), long: int = 1100) -> Column:
    """Two strong fields of each characters or more, or one of total, or a body of long characters with two of the cues:
    enough to judge a record by."""
    folded = F.lit("") if body is None else fold_accents(body)
    hits = sum((F.when(folded.rlike(p), 1).otherwise(0) for p in cues), F.lit(0))
    rendered = (F.length(folded) >= long) & (hits >= 2)
    sizes = F.transform(F.filter(leaves, lambda x: F.lower(leaf_name(x["path"])).isin(*strong) & (F.length(clean_text(x["value"])) >= each)), lambda x: F.length(clean_text(x["value"])))
    return (F.size(sizes) >= 2) | ((F.size(sizes) == 1) & (F.coalesce(F.array_max(sizes), F.lit(0)) >= total)) | rendered


@F.pandas_udf(StringType())
def _typed(scripts: pd.Series, kind: pd.Series) -> pd.Series:
    def first(own, k):
        for s in own if own is not None else ():
            for _, v in _walk(_parsed(s)):
                if isinstance(v, dict):
                    t = v.get("@type")
                    if k.lower() in {str(x).lower() for x in (t if isinstance(t, list) else [t])}:
                        return json.dumps(v)
        return ""

    return pd.Series([first(own, k) for own, k in zip(scripts, kind)])


def linked_object(html: Column, kind: str) -> Column:
    """JSON of the first object of a kind, at any depth, in the page's linked data; empty if there is none."""
    scripts = F.regexp_extract_all(blank(html), F.lit("(?is)<script[^>]*ld\\+json[^>]*>(.*?)</script>"), F.lit(1))
    return _typed(scripts, F.lit(kind))


def named(obj: Column, field: str) -> Column:
    """A field that is a text, or an object with a name."""
    raw = F.coalesce(F.get_json_object(obj, f"$.{field}"), F.lit(""))
    return clean_text(F.when(raw.startswith("{"), F.get_json_object(raw, "$.name")).otherwise(raw))


def places(obj: Column, field: str = "jobLocation", parts: tuple[str, ...] = ("addressLocality", "addressRegion", "addressCountry")) -> Column:
    """Addresses of one place or a list of them: parts joined by commas, places by semicolons, each once."""
    raw = F.coalesce(F.get_json_object(obj, f"$.{field}"), F.lit("[]"))
    listed = F.from_json(F.when(raw.startswith("["), raw).otherwise(F.concat(F.lit("["), raw, F.lit("]"))), f"array<struct<address:struct<{','.join(f'{p}:string' for p in parts)}>>>")
    text = lambda v: clean_text(F.when(v.startswith("{"), F.get_json_object(v, "$.name")).otherwise(v))
    each = F.transform(listed, lambda x: F.array_join(F.array_distinct(F.filter(F.array(*(text(x["address"][p]) for p in parts)), lambda v: v != "")), ", "))
    return F.coalesce(F.array_join(F.array_distinct(F.filter(each, lambda v: v != "")), "; "), F.lit(""))


def looks_partial(rendered: Column, external: Column, cues: Sequence[str], least: int = 650) -> Column:
    """A rendered record that is no detail of its own: shorter than least characters, or it points to a page outside."""
    low = F.lower(clean_text(rendered))
    outside = F.size(F.coalesce(external, F.array().cast("array<string>"))) > 0
    cue = F.lit(False)
    for c in cues:
        cue = cue | F.contains(low, F.lit(c.lower()))
    return (outside & cue) | (F.length(low) < least)
