"""Text functions. Positions count from 1; a null argument gives null."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def Join(*parts: Column) -> Column:
    """P10: the & operator; null if any part is."""
    return F.concat(*parts)


def Left(s: Column, n: int) -> Column:
    """F12."""
    return F.left(s, F.lit(n))


def Right(s: Column, n: int) -> Column:
    """F13."""
    return F.right(s, F.lit(n))


def Mid(s: Column, start: int, n: int | None = None) -> Column:
    """without n to the end."""
    return F.substr(s, F.lit(start)) if n is None else F.substr(s, F.lit(start), F.lit(n))


def Len(s: Column) -> Column:
    """F15."""
    return F.length(s)


def Upper(s: Column) -> Column:
    """F16."""
    return F.upper(s)


def Lower(s: Column) -> Column:
    """F17."""
    return F.lower(s)


def Trim(s: Column) -> Column:
    """F18."""
    return F.trim(s)


def LTrim(s: Column) -> Column:
    """F19."""
    return F.ltrim(s)


def RTrim(s: Column) -> Column:
    """F20."""
    return F.rtrim(s)


def Index(s: Column, sub: str) -> Column:
    """place of the first occurrence, 0 for none."""
    return F.locate(sub, s)


def SubField(s: Column, delimiter: str, n: int) -> Column:
    """the n-th part; from the end for negative n; empty beyond; null for 0, as parts count from 1."""
    return F.split_part(s, F.lit(delimiter), F.lit(n)) if n else F.lit(None).cast("string")


def SubFields(s: Column, delimiter: str) -> Column:
    """F22 without a number: one row a part; used in a select."""
    return F.explode(F.split(s, re.escape(delimiter)))


def Replace(s: Column, old: str, new: str) -> Column:
    """F23."""
    return F.replace(s, F.lit(old), F.lit(new))


def PurgeChar(s: Column, chars: str) -> Column:
    """without these characters, each taken literally."""
    return F.translate(s, chars, "")


def KeepChar(s: Column, chars: str) -> Column:
    """only these characters, each taken literally."""
    return F.call_function("translate", s, F.translate(s, chars, ""), F.lit(""))


def Capitalize(s: Column) -> Column:
    """each blank-separated word with a capital first letter and the rest lower."""
    return F.initcap(s)


def Chr(n: Column) -> Column:
    """character of a code from 0 to 255."""
    return F.char(n)


def Ord(s: Column) -> Column:
    """code of the first character."""
    return F.ascii(s)


def Repeat(s: Column, n: int) -> Column:
    """F29."""
    return F.repeat(s, n)


def Text(x: Column) -> Column:
    """F30."""
    return x.cast("string")


def SubStringCount(s: Column, sub: str) -> Column:
    """occurrences that don't overlap; null for an empty sub."""
    if not sub:
        return F.lit(None).cast("int")
    return ((F.length(s) - F.length(F.replace(s, F.lit(sub), F.lit("")))) / len(sub)).cast("int")


def TextBetween(s: Column, before: str, after: str) -> Column:
    """F32 (own choice): what stands after the first `before` up to the next `after`; null if either is absent."""
    at = F.locate(before, s)
    rest = F.substr(s, at + len(before))
    end = F.locate(after, rest)
    return F.when((at > 0) & (end > 0), F.substr(rest, F.lit(1), end - 1))


def FindOneOf(s: Column, chars: str) -> Column:
    """F33 (own choice): place of the first of these characters, 0 for none, and if there are no characters."""
    found = [F.nullif(F.locate(c, s), F.lit(0)) for c in chars] or [F.lit(None).cast("int")]
    first = F.least(*found) if len(found) > 1 else found[0]
    return F.when(s.isNotNull(), F.coalesce(first, F.lit(0)))


def _joined(values: tuple[Column, ...]) -> Column:
    return F.concat_ws("\x1f", *[v.cast("string") for v in values]).cast("binary")


def Hash128(*values: Column) -> Column:
    """F34 (own choice): MD5 of the values as text, joined by a unit separator without nulls, in hex."""
    return F.md5(_joined(values))


def Hash256(*values: Column) -> Column:
    """F35 (own choice): SHA-256 likewise."""
    return F.sha2(_joined(values), 256)
