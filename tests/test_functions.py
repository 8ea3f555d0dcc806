from datetime import date

import pytest
from pyspark.sql import functions as F

from loadflow.functions import cond as C
from loadflow.functions import dates as D
from loadflow.functions import numeric as N
from loadflow.functions import string as S
from loadflow.functions.registry import FUNCTIONS, call, register

lit = F.lit
none = lambda: F.lit(None).cast("string")


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: C.If(none() == "x", lit(1), lit(2)), 2), (lambda: C.Alt(none(), lit("b")), "b"), (lambda: C.Pick(lit(3), lit("a"), lit("b")), None), (lambda: C.Match(none(), "a"), 0),
        (lambda: C.MixMatch(lit("AB"), "x", "aB"), 2), (lambda: C.WildMatch(lit("50% off"), "5_*", "50%*"), 2), (lambda: C.WildMatch(lit("abc"), "A?C"), 1), (lambda: C.Class(lit(-3), 5), "-5<=x<0"),
        (lambda: S.Join(lit("a"), none()), None), (lambda: S.Mid(lit("hello"), 2), "ello"), (lambda: S.Mid(lit("hello"), 2, 2), "el"), (lambda: S.Index(lit("abc"), "z"), 0), (lambda: S.SubField(lit("a;b"), ";", 3), ""),
        (lambda: S.SubField(lit("a;b"), ";", -1), "b"), (lambda: S.KeepChar(lit("a-1]^2"), "0-9]^"), "-]^"), (lambda: S.PurgeChar(lit("a-1]^2"), "-]^"), "a12"), (lambda: S.KeepChar(lit(""), "a"), ""),
        (lambda: S.SubStringCount(lit("aaa"), "aa"), 1), (lambda: S.SubStringCount(lit("aaa"), ""), None), (lambda: S.TextBetween(lit("<b>x</b>"), "<b>", "</b>"), "x"), (lambda: S.TextBetween(lit("<b>x"), "<b>", "</b>"), None),
        (lambda: S.FindOneOf(lit("hello"), "lo"), 3), (lambda: S.FindOneOf(lit("hello"), "xy"), 0), (lambda: S.FindOneOf(none(), "x"), None), (lambda: S.Capitalize(lit("o'NEILL jr")), "O'neill Jr"),
        (lambda: N.Num(lit("1e3")), 1000.0), (lambda: N.Num(lit("x")), None), (lambda: N.Div(lit(-7), lit(2)), -4), (lambda: N.Div(lit(1), lit(0)), None), (lambda: N.Mod(lit(-7), lit(2)), -1), (lambda: N.Mod(lit(1), lit(0)), None),
        (lambda: N.Sqrt(lit(-1.0)), None), (lambda: N.Log(lit(0.0)), None), (lambda: N.Round(lit(2.5)), 3.0), (lambda: N.Frac(lit(-1.25)), 0.75), (lambda: N.RangeSum(lit(None).cast("int"), lit(2)), 2),
        (lambda: N.RangeAvg(lit(None).cast("int"), lit(None).cast("int")), None), (lambda: N.RangeMax(lit(None).cast("int"), lit(2)), 2), (lambda: N.Sign(lit(-2.5)), -1),
        (lambda: D.Date(lit("31.12.2024"), "DD.MM.YYYY"), date(2024, 12, 31)), (lambda: D.Date(lit("2024-02-30"), "YYYY-MM-DD"), None), (lambda: D.Date(lit(date(2024, 3, 1)), "YYYYMM", is_text=False), "202403"),
        (lambda: D.Date(lit("2024-02-29")), date(2024, 2, 29)), (lambda: D.MakeDate(lit(2023), 2, 29), None), (lambda: D.MakeDate(lit(2024)), date(2024, 1, 1)), (lambda: D.MakeTime(lit(1), lit(2), lit(3)), "01:02:03"),
        (lambda: D.WeekDay(lit(date(2024, 1, 1))), 0), (lambda: D.WeekDay(lit(date(2024, 1, 1)), 6), 1), (lambda: D.AddMonths(lit(date(2024, 1, 31)), 1), date(2024, 2, 29)), (lambda: D.AddYears(lit(date(2024, 2, 29)), 1), date(2025, 2, 28)),
        (lambda: D.Age(lit(date(2025, 2, 28)), lit(date(2004, 2, 29))), 20), (lambda: D.Age(lit(date(2025, 3, 1)), lit(date(2004, 2, 29))), 21), (lambda: D.YearEnd(lit(date(2024, 2, 1))), date(2024, 12, 31)),
        (lambda: D.NetWorkDays(lit(date(2024, 1, 6)), lit(date(2024, 1, 7))), 0), (lambda: D.NetWorkDays(lit(date(2024, 1, 1)), lit(date(2024, 1, 12)), [date(2024, 1, 1), date(2024, 1, 6)]), 9),
        (lambda: D.NetWorkDays(lit(date(2024, 1, 9)), lit(date(2024, 1, 8))), 0), (lambda: D.Interval(lit(1.5)), "36:00:00"), (lambda: D.QuarterName(lit(date(2024, 5, 9))), "Apr-Jun 2024"),
    ],
)
def test_values(spark, column, want):
    assert value(spark, column()) == want


def test_format_tokens():
    assert D.spark_format("YYYY-MM-DD hh:mm:ss") == "yyyy-MM-dd HH:mm:ss"
    assert D.spark_format("DD.MM.YYTx") == "dd.MM.yy'Tx'"


def test_subfields_take_the_delimiter_literally(spark):
    assert [r[0] for r in spark.range(1).select(S.SubFields(lit("a.b|c"), "|")).collect()] == ["a.b", "c"]


def test_hashes_differ_by_border(spark):
    assert value(spark, S.Hash128(lit("a"), lit("bc"))) != value(spark, S.Hash128(lit("ab"), lit("c")))
    assert len(value(spark, S.Hash256(lit("a")))) == 64


def test_function_table(spark):
    register("Twice", lambda x: x * 2)
    assert value(spark, call("twice", lit(4))) == 8
    with pytest.raises(KeyError):
        call("nope")
    with pytest.raises(TypeError):
        call("Left", lit("a"))
    assert {"if", "applymap"} & set(FUNCTIONS) == {"if"} and len(FUNCTIONS) >= 100


def test_networkdays_against_counting(spark):
    from datetime import timedelta

    starts = [date(2023, 12, 28) + timedelta(i) for i in range(9)]
    df = spark.createDataFrame([(a, a + timedelta(n)) for a in starts for n in range(16)], "a date, b date")
    for a, b, n in df.select("a", "b", D.NetWorkDays(F.col("a"), F.col("b"))).collect():
        assert n == sum((a + timedelta(i)).weekday() < 5 for i in range((b - a).days + 1))
