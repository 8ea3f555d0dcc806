"""Aggregates of a load pipeline as columns for groupBy().agg(), and aggregates over aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loadflow.sources.shared import written


def Sum(x: Column) -> Column:
    """A1."""
    return F.sum(x)


def Count(x: Column) -> Column:
    """A2: values that aren't null."""
    return F.count(x)


def Avg(x: Column) -> Column:
    """A3."""
    return F.avg(x)


def Min(x: Column) -> Column:
    """A4."""
    return F.min(x)


def Max(x: Column) -> Column:
    """A5."""
    return F.max(x)


def Only(x: Column, strict: bool = False) -> Column:
    """The least value; strict: null if there are several."""
    return F.when(F.min(x) == F.max(x), F.min(x)) if strict else F.min(x)


def Median(x: Column, approx: bool = False) -> Column:
    """Exact with interpolation, the values of a group in one task; see fractiles for large groups."""
    return F.percentile_approx(x, 0.5, 10_000) if approx else F.median(x)


def Stdev(x: Column) -> Column:
    """Of a sample."""
    return F.stddev_samp(x)


def Mode(x: Column) -> Column:
    """The most frequent value, the least of these on a tie; the distinct values of a group in one task. See modes for large groups."""
    return F.mode(x, True)


def Concat(x: Column | str, separator: str = ",", distinct: bool = False) -> Column:
    """A10: values as text in their order, joined. The order is part of the result, so it is by value."""
    text = (F.col(x) if isinstance(x, str) else x).cast("string")
    values = F.collect_set(text) if distinct else F.collect_list(text)
    return F.when(F.size(values) > 0, F.array_join(F.sort_array(values), separator))


def FirstSortedValue(value: Column, sort_key: Column) -> Column:
    """A11 (own choice): the value with the least key; of equal keys the least value. Null keys don't count."""
    return F.min_by(value, F.when(sort_key.isNotNull(), F.struct(sort_key, value)))


def Fractile(x: Column, p: float, approx: bool = False) -> Column:
    """A12 (own choice): quantile with interpolation between neighbours; see fractiles for large groups."""
    return F.percentile_approx(x, p, 10_000) if approx else F.percentile(x, F.lit(p))


def FieldValueCount(x: Column, approx: bool = False) -> Column:
    """A14 (own choice): number of distinct values that aren't null."""
    return F.approx_count_distinct(x) if approx else F.count_distinct(x)


def aggr(df: DataFrame, dims: list[str | Column], inner: dict[str, Column], by: list[str], outer: dict[str, Column]) -> DataFrame:
    """A13 (own choice): outer aggregates over `by` of inner aggregates over `dims`, which must hold `by`."""
    inside = df.groupBy(*dims).agg(*[c.alias(k) for k, c in inner.items()])
    return inside.groupBy(*by).agg(*[c.alias(k) for k, c in outer.items()])


def fractiles(df: DataFrame, by: list[str], x: Column, wanted: dict[str, float]) -> DataFrame:
    """A7, A12 for groups of any size: by, and an exact quantile of x with interpolation for each entry of wanted (name: p).

    Values are counted, and dealt by ranges of (group, value). Prefix sums over the counts of a group's ranges and inside a
    range give each value's places, so that no task holds a group. Nulls don't count; a group of nulls only has null quantiles.
    """
    counts = df.select(*by, x.cast("double").alias("_x")).groupBy(*by, "_x").agg(F.count("_x").alias("_n"))
    counts = written(counts.repartitionByRange(*by, "_x").withColumn("_part", F.spark_partition_id()))
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy(*by, "_part").agg(F.sum("_n").alias("_in"))
    parts = parts.withColumn("_first", F.coalesce(F.sum("_in").over(past(Window.partitionBy(*by).orderBy("_part"))), F.lit(0))).withColumn("_all", F.sum("_in").over(Window.partitionBy(*by)))
    parts = parts.select(*[F.col(f"`{c}`").alias(f"_by{i}") for i, c in enumerate(by)], F.col("_part").alias("_p"), "_first", "_all")
    same = [F.col(f"`{c}`").eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
    placed = counts.withColumn("_inside", F.coalesce(F.sum("_n").over(past(Window.partitionBy("_part", *by).orderBy("_x"))), F.lit(0)))
    placed = placed.join(parts, [*same, F.col("_part") == F.col("_p")]).withColumn("_at", F.col("_first") + F.col("_inside"))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_at") <= place) & (place < F.col("_at") + F.col("_n")), F.col("_x")))

    def quantile(p: float) -> Column:
        place = F.lit(p) * (F.col("_all") - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        return low + (high - low) * F.max(place - F.floor(place))

    return placed.groupBy(*by).agg(*[quantile(p).alias(name) for name, p in wanted.items()])


def modes(df: DataFrame, by: list[str], x: Column, out: str) -> DataFrame:
    """A9 for groups of any size: by, and the most frequent value of x, the least of these on a tie. Two aggregates; nulls don't count."""
    counts = df.select(*by, x.alias(out)).groupBy(*by, out).agg(F.count(out).alias("_n"))
    return counts.groupBy(*by).agg(F.min_by(out, F.when(F.col(out).isNotNull(), F.struct(-F.col("_n"), F.col(out)))).alias(out))
