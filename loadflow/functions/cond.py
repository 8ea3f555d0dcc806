"""Conditions and nulls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def If(condition: Column, then: Column, other: Column | None = None) -> Column:
    """a null condition counts as false."""
    return F.when(condition, then).otherwise(other)


def Alt(*values: Column) -> Column:
    """the first that isn't null."""
    return F.coalesce(*values)


def IsNull(x: Column) -> Column:
    """F3."""
    return x.isNull()


def NullAsValue(x: Column, value: Column) -> Column:
    """F4."""
    return F.coalesce(x, value)


def Not(x: Column) -> Column:
    """F5."""
    return ~x


def NullIf(a: Column, b: Column) -> Column:
    """null where both are equal."""
    return F.nullif(a, b)


def Pick(n: Column, *values: Column) -> Column:
    """F7 (own choice): the n-th value from 1; null beyond."""
    out = F.when(n == 1, values[0])
    for i, v in enumerate(values[1:], 2):
        out = out.when(n == i, v)
    return out


def _first_match(tests: list[Column]) -> Column:
    out = F.when(tests[0], 1)
    for i, t in enumerate(tests[1:], 2):
        out = out.when(t, i)
    return out.otherwise(0)


def Match(x: Column, *values: object) -> Column:
    """F8 (own choice): place of the first equal value from 1, or 0; 0 for null."""
    return _first_match([x == v for v in values])


def MixMatch(x: Column, *values: str) -> Column:
    """F9 (own choice): Match without regard to case."""
    return Match(F.lower(x), *[v.lower() for v in values])


def WildMatch(x: Column, *patterns: str) -> Column:
    """F10 (own choice): place of the first pattern that fits, without regard to case; * is any text, ? one character."""

    def like(p: str) -> str:
        for a in ("\\", "%", "_"):
            p = p.replace(a, "\\" + a)
        return p.replace("*", "%").replace("?", "_")

    return _first_match([x.ilike(like(p)) for p in patterns])


def Class(x: Column, width: int) -> Column:
    """F11 (own choice): the bucket's text, "lo<=x<hi"."""
    low = (F.floor(x / width) * width).cast("long")
    return F.concat(low.cast("string"), F.lit("<=x<"), (low + width).cast("string"))
