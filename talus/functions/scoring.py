"""Additive scores with caps, blockers and buckets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Buckets and their least scores; ranks of recommendations.
BUCKETS = (("STRONG_APPLY", 90), ("APPLY", 80), ("REVIEW", 65), ("LOW_PRIORITY", 50))
RANKS = {"STRONG_APPLY": 0, "APPLY": 1, "REVIEW": 2, "LOW_PRIORITY": 3, "NEEDS_DETAIL_REVIEW": 4, "SKIP": 5}


def capped(n: Column, each: int, most: int, least: Column | int = 0) -> Column:
    """each points a hit, most at the utmost, least at the least."""
    return F.greatest(F.least(n * each, F.lit(most)), least if isinstance(least, Column) else F.lit(least))


def lookup(value: Column, points: Mapping[str, int], otherwise: int = 0) -> Column:
    out = None
    for name, n in points.items():
        out = (out.when if out is not None else F.when)(value == name, n)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def score(components: Sequence[Column], caps: Sequence[tuple[Column, int]] = (), blocked: Column | None = None) -> Column:
    """The components' sum under the caps whose conditions hold; 0 if blocked. Caps are a minimum, so order is free."""
    total = sum(components[1:], components[0])
    if caps:
        total = F.least(total, *(F.when(condition, most).otherwise(2**31 - 1) for condition, most in caps))
    return total if blocked is None else F.when(blocked, 0).otherwise(total)


def location_points(place: Column, home: Sequence[str], remote: str, elsewhere: str, points: tuple[int, int, int, int, int] = (5, 4, 1, 3, 0)) -> Column:
    """Points of a normalised text of place, modality and description: home is named; remote within reach, without or with a
    demand to live elsewhere; remote without a place; none of it."""
    at_home, far = F.exists(F.array(*map(F.lit, home)), lambda h: F.contains(place, h)), place.rlike(elsewhere)
    return F.when(at_home, points[0]).when(place.rlike(remote) & ~far, points[1]).when(place.rlike(remote), points[2]).when(place.rlike(r"remote"), points[3]).otherwise(points[4])


def bucket(score_: Column, buckets: Sequence[tuple[str, int]] = BUCKETS, otherwise: str = "SKIP") -> Column:
    out = None
    for name, least in buckets:
        out = (out.when if out is not None else F.when)(score_ >= least, name)
    return out.otherwise(otherwise)


def rank(recommendation: Column, ranks: Mapping[str, int] = RANKS) -> Column:
    """The recommendation's place; 99 if unknown."""
    return lookup(recommendation, ranks, 99)
