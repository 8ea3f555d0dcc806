"""Queries: the function library, several functions a query, over the given tables."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadflow.functions import cond as C
from loadflow.functions import dates as D
from loadflow.functions import numeric as N
from loadflow.functions import string as S
from loadflow.functions.registry import call
from loadflow.plans.common import query, table


@query("""SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'Y' ELSE 'N' END AS f1, coalesce(CASE WHEN c_acctbal < 0 THEN 'neg' END, CASE WHEN c_acctbal > 5000 THEN 'rich' END, 'mid') AS f2,
  CASE WHEN c_acctbal > 0 THEN c_acctbal END IS NULL AS f3, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, -1.0) AS f4, NOT (c_acctbal > 0) AS f5, nullif(c_mktsegment, 'BUILDING') AS f6 FROM customer""")
def f1_f6_conditions(spark: SparkSession, sf: str) -> DataFrame:
    bal = F.col("c_acctbal")
    some = F.when(bal > 0, bal)
    return table(spark, sf, "customer").select(
        "c_custkey", C.If(bal > 0, F.lit("Y"), F.lit("N")).alias("f1"), C.Alt(F.when(bal < 0, "neg"), F.when(bal > 5000, "rich"), F.lit("mid")).alias("f2"), C.IsNull(some).alias("f3"),
        C.NullAsValue(some, F.lit(-1.0)).alias("f4"), C.Not(bal > 0).alias("f5"), C.NullIf(F.col("c_mktsegment"), F.lit("BUILDING")).alias("f6"),
    )


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 1 THEN 'a' WHEN 2 THEN 'b' END AS f7, CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'PROMO' THEN 2 ELSE 0 END AS f8, CASE lower(p_type) WHEN 'economy' THEN 1 WHEN 'standard' THEN 2 ELSE 0 END AS f9,
  CASE WHEN p_name ILIKE 'small%' THEN 1 WHEN p_name ILIKE '_ed %' THEN 2 ELSE 0 END AS f10, CAST(CAST(floor(p_size / 10.0) * 10 AS BIGINT) AS VARCHAR) || '<=x<' || CAST(CAST(floor(p_size / 10.0) * 10 + 10 AS BIGINT) AS VARCHAR) AS f11 FROM part""")
def f7_f11_matching(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        "p_partkey", C.Pick(F.col("p_size") % 4, F.lit("a"), F.lit("b")).alias("f7"), C.Match(F.col("p_type"), "ECONOMY", "PROMO").alias("f8"), C.MixMatch(F.col("p_type"), "Economy", "Standard").alias("f9"),
        C.WildMatch(F.col("p_name"), "SMALL*", "?ed *").alias("f10"), C.Class(F.col("p_size"), 10).alias("f11"),
    )


@query("""SELECT c_custkey, left(c_name, 4) AS f12, right(c_name, 3) AS f13, substr(c_name, 10) AS f14a, substr(c_name, 3, 4) AS f14b, CAST(length(c_name) AS INTEGER) AS f15, upper(c_name) AS f16, lower(c_name) AS f17,
  trim('  ' || c_name || ' ') AS f18, ltrim('  ' || c_name || ' ') AS f19, rtrim('  ' || c_name || ' ') AS f20, CAST(position('#' IN c_name) AS INTEGER) AS f21, split_part(c_name, '#', 2) AS f22, replace(c_name, '0', 'o') AS f23 FROM customer""")
def f12_f23_strings(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("c_name")
    padded = S.Join(F.lit("  "), name, F.lit(" "))
    return table(spark, sf, "customer").select(
        "c_custkey", S.Left(name, 4).alias("f12"), S.Right(name, 3).alias("f13"), S.Mid(name, 10).alias("f14a"), S.Mid(name, 3, 4).alias("f14b"), S.Len(name).alias("f15"), S.Upper(name).alias("f16"), S.Lower(name).alias("f17"),
        S.Trim(padded).alias("f18"), S.LTrim(padded).alias("f19"), S.RTrim(padded).alias("f20"), S.Index(name, "#").alias("f21"), S.SubField(name, "#", 2).alias("f22"), S.Replace(name, "0", "o").alias("f23"),
    )


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS part FROM part")
def f22_subfields(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", S.SubFields(F.col("p_name"), " ").alias("part"))


@query("""SELECT p_partkey, translate(p_brand, translate(p_brand, '0123456789', ''), '') AS f24, translate(p_brand, 'Bd#', '') AS f25,
  array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS f26, chr(65 + p_size % 26) AS f27, CAST(ascii(p_name) AS INTEGER) AS f28, repeat(p_type, 2) AS f29, CAST(p_size AS VARCHAR) AS f30,
  CAST((length(p_name) - length(replace(p_name, 'e', ''))) AS INTEGER) AS f31 FROM part""")
def f24_f31_strings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        "p_partkey", S.KeepChar(F.col("p_brand"), "0123456789").alias("f24"), S.PurgeChar(F.col("p_brand"), "Bd#").alias("f25"), S.Capitalize(F.col("p_name")).alias("f26"), S.Chr(65 + F.col("p_size") % 26).alias("f27"),
        S.Ord(F.col("p_name")).alias("f28"), S.Repeat(F.col("p_type"), 2).alias("f29"), S.Text(F.col("p_size")).alias("f30"), S.SubStringCount(F.col("p_name"), "e").alias("f31"),
    )


@query("""SELECT event_id, CASE WHEN position('": ' IN props) > 0 AND position('}' IN substr(props, position('": ' IN props) + 3)) > 0 THEN split_part(substr(props, position('": ' IN props) + 3), '}', 1) END AS f32,
  CAST(coalesce(least(nullif(position('k' IN props), 0), nullif(position('5' IN props), 0), nullif(position('}' IN props), 0)), 0) AS INTEGER) AS f33, md5(CAST(user_id AS VARCHAR) || chr(31) || event_type) AS f34,
  sha256(CAST(user_id AS VARCHAR) || chr(31) || event_type) AS f35 FROM events""")
def f32_f35_strings(spark: SparkSession, sf: str) -> DataFrame:
    props = F.col("props")
    keys = (F.col("user_id"), F.col("event_type"))
    return table(spark, sf, "events").select("event_id", S.TextBetween(props, '": ', "}").alias("f32"), S.FindOneOf(props, "k5}").alias("f33"), S.Hash128(*keys).alias("f34"), S.Hash256(*keys).alias("f35"))


@query("""SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE CAST(o_orderkey AS VARCHAR) END AS DOUBLE) AS f36, CAST(round(CAST(o_totalprice AS DECIMAL(18,2)), 1) AS DOUBLE) AS f37, CAST(floor(o_totalprice) AS BIGINT) AS f38,
  CAST(ceil(o_totalprice) AS BIGINT) AS f39, abs(o_orderkey - 500) AS f40, round(pow(o_orderkey % 7, 2), 6) AS f41, (o_orderkey - 500) % 7 AS f42, CAST(sign(o_orderkey - 500) AS INTEGER) AS f43, round(sqrt(o_totalprice), 6) AS f44,
  round(exp(o_orderkey % 5), 6) AS f45, round(ln(o_orderkey + 1), 6) AS f46, round(log10(o_orderkey + 1), 6) AS f47, CAST(floor((o_orderkey - 500) / 7) AS BIGINT) AS f48, round(o_totalprice - floor(o_totalprice), 4) AS f49,
  o_orderkey % 2 = 0 AS f50, o_orderkey % 2 <> 0 AS f51 FROM orders""")
def f36_f51_numbers(spark: SparkSession, sf: str) -> DataFrame:
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        "o_orderkey", N.Num(F.when(k % 5 == 0, "x").otherwise(k.cast("string"))).alias("f36"), N.Round(p.cast("decimal(18,2)"), 1).cast("double").alias("f37"), N.Floor(p).alias("f38"), N.Ceil(p).alias("f39"),
        N.Abs(k - 500).alias("f40"), F.round(N.Pow(k % 7, 2), 6).alias("f41"), N.Mod(k - 500, F.lit(7)).alias("f42"), N.Sign(k - 500).alias("f43"), F.round(N.Sqrt(p), 6).alias("f44"), F.round(N.Exp(k % 5), 6).alias("f45"),
        F.round(N.Log(k + 1), 6).alias("f46"), F.round(N.Log10(k + 1), 6).alias("f47"), N.Div(k - 500, F.lit(7)).alias("f48"), F.round(N.Frac(p), 4).alias("f49"), N.Even(k).alias("f50"), N.Odd(k).alias("f51"),
    )


@query("""SELECT l_orderkey, l_linenumber, least(l_discount, l_tax) AS f52, greatest(l_discount, l_tax) AS f53, round(coalesce(CASE WHEN l_tax > 0 THEN l_tax END, 0) + l_discount, 6) AS f54,
  CAST((CASE WHEN l_tax > 0 THEN 1 ELSE 0 END) + 1 AS INTEGER) AS f55, round((coalesce(CASE WHEN l_tax > 0 THEN l_tax END, 0) + l_discount) / ((CASE WHEN l_tax > 0 THEN 1 ELSE 0 END) + 1), 6) AS f56 FROM lineitem""")
def f52_f56_ranges(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.when(F.col("l_tax") > 0, F.col("l_tax")), F.col("l_discount")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", N.RangeMin(b, F.col("l_tax")).alias("f52"), N.RangeMax(b, F.col("l_tax")).alias("f53"), F.round(N.RangeSum(a, b), 6).alias("f54"), N.RangeCount(a, b).alias("f55"), F.round(N.RangeAvg(a, b), 6).alias("f56"),
    )


@query("""SELECT o_orderkey, DATE '2002-03-31' AS f57, TIMESTAMP '2002-03-31 12:30:00' AS f58, CAST(try_strptime(strftime(o_orderdate, '%d.%m.%Y'), '%d.%m.%Y') AS DATE) AS f59a, strftime(o_orderdate, '%Y%m') AS f59b,
  CAST(try_strptime(strftime(o_orderdate, '%Y-%m-%d') || ' 07:08:09', '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS f60, CASE WHEN o_orderkey % 31 + 1 <= day(last_day(make_date(1999, 2, 1))) THEN make_date(1999, 2, CAST(o_orderkey % 31 + 1 AS INTEGER)) END AS f61,
  printf('%02d:%02d:%02d', CAST(o_orderkey % 24 AS INTEGER), CAST(o_orderkey % 60 AS INTEGER), 5) AS f62 FROM orders""")
def f57_f62_dates(spark: SparkSession, sf: str) -> DataFrame:
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        "o_orderkey", D.Today(date(2002, 3, 31)).alias("f57"), D.Now(datetime(2002, 3, 31, 12, 30)).cast("timestamp_ntz").alias("f58"), D.Date(F.date_format(d, "dd.MM.yyyy"), "DD.MM.YYYY").alias("f59a"),
        D.Date(d, "YYYYMM", is_text=False).alias("f59b"), D.Timestamp(F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" 07:08:09")), "YYYY-MM-DD hh:mm:ss").cast("timestamp_ntz").alias("f60"),
        D.MakeDate(F.lit(1999), 2, (k % 31 + 1).cast("int")).alias("f61"), D.MakeTime((k % 24).cast("int"), (k % 60).cast("int"), F.lit(5)).alias("f62"),
    )


@query("""SELECT event_id, CAST(year(ts) AS INTEGER) AS f63, CAST(month(ts) AS INTEGER) AS f64, CAST(day(ts) AS INTEGER) AS f65, CAST(week(ts) AS INTEGER) AS f66, CAST(hour(ts) AS INTEGER) AS f67, CAST(minute(ts) AS INTEGER) AS f68, CAST(second(ts) AS INTEGER) AS f69,
  CAST(isodow(ts) - 1 AS INTEGER) AS f70, CAST((isodow(ts) - 1 + 1) % 7 AS INTEGER) AS f70_sunday FROM events""")
def f63_f70_parts(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("ts")
    return table(spark, sf, "events").select(
        "event_id", D.Year(t).alias("f63"), D.Month(t).alias("f64"), D.Day(t).alias("f65"), D.Week(t).alias("f66"), D.Hour(t).alias("f67"), D.Minute(t).alias("f68"), D.Second(t).alias("f69"), D.WeekDay(t).alias("f70"), D.WeekDay(t, 6).alias("f70_sunday"),
    )


@query("""SELECT o_orderkey, CAST(date_trunc('month', d) AS DATE) AS f71, last_day(d) AS f72, CAST(date_trunc('year', d) AS DATE) AS f73, CAST(date_trunc('year', d) + INTERVAL 12 MONTH - INTERVAL 1 DAY AS DATE) AS f74, CAST(date_trunc('quarter', d) AS DATE) AS f75,
  CAST(date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS f76, CAST(date_trunc('week', d) AS DATE) AS f77, CAST(d + INTERVAL 13 MONTH AS DATE) AS f78, CAST(d + INTERVAL 1 YEAR AS DATE) AS f79 FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def f71_f79_periods(spark: SparkSession, sf: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    fns = (D.MonthStart, D.MonthEnd, D.YearStart, D.YearEnd, D.QuarterStart, D.QuarterEnd, D.WeekStart)
    return table(spark, sf, "orders").select("o_orderkey", *[f(d).alias(f"f{i}") for i, f in enumerate(fns, 71)], D.AddMonths(d, 13).alias("f78"), D.AddYears(d, 1).alias("f79"))


@query("""SELECT o_orderkey, printf('%02d:%02d:%02d', CAST(floor(s / 3600) AS BIGINT), CAST(floor((s % 3600) / 60) AS BIGINT), s % 60) AS f80, CAST(date_diff('year', d, DATE '2002-03-31') - CASE WHEN month(d) * 100 + day(d) > 331 THEN 1 ELSE 0 END AS INTEGER) AS f81,
  CAST((SELECT count(*) FROM range(0, 20) r(i) WHERE isodow(d + CAST(i AS INTEGER)) < 6 AND d + CAST(i AS INTEGER) <> DATE '1999-01-01') AS INTEGER) AS f82, strftime(d, '%b %Y') AS f83,
  strftime(date_trunc('quarter', d), '%b') || '-' || strftime(date_trunc('quarter', d) + INTERVAL 2 MONTH, '%b') || ' ' || strftime(d, '%Y') AS f84, strftime(d, '%Y-%m-%d') AS f85
  FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST((o_orderkey % 200) * 675 AS BIGINT) AS s FROM orders)""")
def f80_f85_periods(spark: SparkSession, sf: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey", D.Interval((F.col("o_orderkey") % 200) / 128).alias("f80"), D.Age(F.lit(date(2002, 3, 31)), d).alias("f81"), D.NetWorkDays(d, F.date_add(d, 19), [date(1999, 1, 1)]).alias("f82"),
        D.MonthName(d).alias("f83"), D.QuarterName(d).alias("f84"), D.DayName(d).alias("f85"),
    )


@query("SELECT c_custkey, upper(left(c_name, 8)) AS code FROM customer")
def x1_function_table(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", call("upper", call("left", F.col("c_name"), 8)).alias("code"))
