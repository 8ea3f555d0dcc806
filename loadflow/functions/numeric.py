"""Number functions. What has no value gives null and never fails."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def Num(x: Column, kind: str = "double") -> Column:
    """a number from text; null if it isn't one. kind may be decimal(38,4)."""
    return x.try_cast(kind)


def Round(x: Column, digits: int = 0) -> Column:
    """halves away from zero."""
    return F.round(x, digits)


def Floor(x: Column) -> Column:
    """F38."""
    return F.floor(x)


def Ceil(x: Column) -> Column:
    """F39."""
    return F.ceil(x)


def Abs(x: Column) -> Column:
    """F40, also FAbs."""
    return F.abs(x)


def Pow(x: Column, y: Column | float) -> Column:
    """F41."""
    return F.pow(x, y)


def Mod(x: Column, y: Column) -> Column:
    """F42, also FMod: the sign of x; null for y = 0."""
    return F.try_mod(x, y)


def Sign(x: Column) -> Column:
    """-1, 0 or 1."""
    return F.sign(x).cast("int")


def Sqrt(x: Column) -> Column:
    """null below 0."""
    return F.when(x >= 0, F.sqrt(x))


def Exp(x: Column) -> Column:
    """F45."""
    return F.exp(x)


def Log(x: Column) -> Column:
    """natural; null up to 0."""
    return F.ln(x)


def Log10(x: Column) -> Column:
    """F47."""
    return F.log10(x)


def Div(x: Column, y: Column) -> Column:
    """the quotient rounded down, so that -7 by 2 is -4; null for y = 0."""
    return F.floor(F.try_divide(x, y))


def Frac(x: Column) -> Column:
    """what is above the floor."""
    return x - F.floor(x)


def Even(x: Column) -> Column:
    """F50."""
    return x % 2 == 0


def Odd(x: Column) -> Column:
    """F51."""
    return x % 2 != 0


def RangeMin(*x: Column) -> Column:
    """without nulls."""
    return F.least(*x) if len(x) > 1 else x[0]


def RangeMax(*x: Column) -> Column:
    """without nulls."""
    return F.greatest(*x) if len(x) > 1 else x[0]


def RangeSum(*x: Column) -> Column:
    """F54 (own choice): nulls count as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0)) for v in x])


def RangeCount(*x: Column) -> Column:
    """F55 (own choice): values that aren't null."""
    return reduce(lambda a, b: a + b, [v.isNotNull().cast("int") for v in x])


def RangeAvg(*x: Column) -> Column:
    """F56 (own choice): mean without nulls; null if all are."""
    return RangeSum(*x).cast("double") / F.nullif(RangeCount(*x), F.lit(0))
