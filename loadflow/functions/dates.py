"""Date and time functions. Formats are written as in load scripts (YYYY-MM-DD hh:mm:ss)."""

from __future__ import annotations

import re
from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Format tokens of load scripts and what Spark calls them. MM is the month, mm the minute.
TOKENS = {"YYYY": "yyyy", "YY": "yy", "MMMM": "MMMM", "MMM": "MMM", "MM": "MM", "M": "M", "DD": "dd", "D": "d", "hh": "HH", "h": "H", "mm": "mm", "ss": "ss", "fff": "SSS"}
_TOKEN = re.compile("|".join(sorted(TOKENS, key=len, reverse=True)) + r"|[A-Za-z]+")


def spark_format(fmt: str) -> str:
    """A load script's format in Spark's letters; letters that are no token stand for themselves."""
    return _TOKEN.sub(lambda m: TOKENS.get(m.group(), f"'{m.group()}'"), fmt)


def Today(as_of: date | None = None) -> Column:
    """the job's date, or the current one."""
    return F.lit(as_of) if as_of else F.current_date()


def Now(as_of: datetime | None = None) -> Column:
    """F58, also UTC and LocalTime: the job's time, or the current one."""
    return F.lit(as_of) if as_of else F.current_timestamp()


def Date(x: Column, fmt: str | None = None, is_text: bool = True) -> Column:
    """text is parsed (null if it doesn't fit); a date or time (is_text=False) is formatted, or cut to a date without fmt."""
    if is_text:
        return F.try_to_date(x, spark_format(fmt)) if fmt else x.try_cast("date")
    return F.date_format(x, spark_format(fmt)) if fmt else x.cast("date")


def Timestamp(x: Column, fmt: str | None = None, is_text: bool = True) -> Column:
    """as Date, for a time."""
    if is_text:
        return F.try_to_timestamp(x, F.lit(spark_format(fmt))) if fmt else x.try_cast("timestamp")
    return F.date_format(x, spark_format(fmt)) if fmt else x.cast("timestamp")


def MakeDate(year: Column, month: Column | int = 1, day: Column | int = 1) -> Column:
    """null for a date that doesn't exist."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, lit(month), lit(day)), "yyyy-MM-dd")


def MakeTime(hour: Column, minute: Column, second: Column) -> Column:
    """as text hh:mm:ss."""
    return F.format_string("%02d:%02d:%02d", hour, minute, second)


def Year(d: Column) -> Column:
    """F63."""
    return F.year(d)


def Month(d: Column) -> Column:
    """F64."""
    return F.month(d)


def Day(d: Column) -> Column:
    """F65."""
    return F.dayofmonth(d)


def Week(d: Column) -> Column:
    """ISO."""
    return F.weekofyear(d)


def Hour(t: Column) -> Column:
    """F67."""
    return F.hour(t)


def Minute(t: Column) -> Column:
    """F68."""
    return F.minute(t)


def Second(t: Column) -> Column:
    """F69."""
    return F.second(t)


def WeekDay(d: Column, first_week_day: int = 0) -> Column:
    """0 is the first day of the week, Monday unless first_week_day (0 Monday .. 6 Sunday) says else."""
    return F.pmod(F.weekday(d) - first_week_day, F.lit(7))


def MonthStart(d: Column) -> Column:
    """F71."""
    return F.trunc(d, "month")


def MonthEnd(d: Column) -> Column:
    """F72."""
    return F.last_day(d)


def YearStart(d: Column) -> Column:
    """F73."""
    return F.trunc(d, "year")


def YearEnd(d: Column) -> Column:
    """F74."""
    return F.date_sub(F.add_months(F.trunc(d, "year"), 12), 1)


def QuarterStart(d: Column) -> Column:
    """F75."""
    return F.trunc(d, "quarter")


def QuarterEnd(d: Column) -> Column:
    """F76."""
    return F.date_sub(F.add_months(F.trunc(d, "quarter"), 3), 1)


def WeekStart(d: Column) -> Column:
    """Monday."""
    return F.trunc(d, "week")


def AddMonths(d: Column, n: int) -> Column:
    """the last day of a shorter month."""
    return F.add_months(d, n)


def AddYears(d: Column, n: int) -> Column:
    """F79."""
    return F.add_months(d, 12 * n)


def Interval(days: Column) -> Column:
    """F80 (own choice): a duration in days as hh:mm:ss, hours beyond 24 counted on."""
    s = F.round(days * 86400).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))


def Age(at: Column, born: Column) -> Column:
    """F81 (own choice): whole years; the year is full on the day of the month, 29 February on 1 March."""
    later = (F.month(at) * 100 + F.dayofmonth(at)) < (F.month(born) * 100 + F.dayofmonth(born))
    return F.year(at) - F.year(born) - F.when(later, 1).otherwise(0)


def NetWorkDays(start: Column, end: Column, holidays: list[date] | None = None) -> Column:
    """F82 (own choice): days from Monday to Friday from start to end, both included, without the holidays; 0 if end is before start."""

    def upto(d: Column) -> Column:  # workdays from Monday 1970-01-05 up to d
        n = F.datediff(d, F.lit(date(1970, 1, 5)))
        return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)) + 1, F.lit(5))

    days = upto(end) - upto(F.date_sub(start, 1))
    for h in sorted({h for h in holidays or [] if h.weekday() < 5}):
        days = days - F.when(F.lit(h).between(start, end), 1).otherwise(0)
    return F.when(end < start, 0).otherwise(days).cast("int")


def MonthName(d: Column) -> Column:
    """F83 (own choice): "Mar 2024"."""
    return F.date_format(d, "MMM yyyy")


def QuarterName(d: Column) -> Column:
    """F84 (own choice): "Jan-Mar 2024"."""
    return F.concat_ws(" ", F.concat_ws("-", F.date_format(QuarterStart(d), "MMM"), F.date_format(QuarterEnd(d), "MMM")), F.date_format(d, "yyyy"))


def DayName(d: Column) -> Column:
    """F85 (own choice): the calendar day as text, "2024-03-31"."""
    return F.date_format(d, "yyyy-MM-dd")
