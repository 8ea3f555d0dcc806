"""Operators that depend on the order of rows. The order is always named, and should be total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loadflow.sources.publish import claimed, current, publish, published
from loadflow.sources.shared import spread, written


def peek(df: DataFrame, field: Column, out: str, order_by: list, partition_by: list | None = None, back: int = 1) -> DataFrame:
    """W1 (own choice): the field's value `back` rows before in the order; null where there is none.

    Without partition_by rows are numbered in parallel and joined to their predecessors by number, so that no task
    holds all rows.
    """
    if partition_by:
        return df.withColumn(out, F.lag(field, back).over(Window.partitionBy(*partition_by).orderBy(*order_by)))
    numbered = written(row_numbers(df.withColumn("_value", field), "_n", order_by))
    before = numbered.select((F.col("_n") + back).alias("_n"), F.col("_value").alias("_before"))
    return numbered.join(before, "_n", "left").drop("_n", "_value").withColumnRenamed("_before", out)


def previous(df: DataFrame, expr: Column, out: str, order_by: list, partition_by: list | None = None) -> DataFrame:
    """W2 (own choice): the expression's value one row before."""
    return peek(df, expr, out, order_by, partition_by, 1)


def row_numbers(df: DataFrame, out: str, order_by: list, partition_by: list | None = None) -> DataFrame:
    """W5 (own choice): numbers from 1, gapless, in the order; within each partition_by if given.

    Global numbers: rows are dealt by ranges of the order and sorted within, a written table fixes the places, and a
    prefix sum over the counts of the ranges (one row each) gives every range's first number. Ranges end inside of one order value too, by a hash of the
    row, so that rows with one value, however many, are dealt to all tasks; which of them comes first is open.
    """
    if partition_by:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*partition_by).orderBy(*order_by)).cast("long"))
    place = F.monotonically_increasing_id()
    tied = [*order_by, "_tie"]
    dealt = df.withColumn("_tie", spread(df)).repartitionByRange(*tied).sortWithinPartitions(*tied)
    ranged = written(dealt.drop("_tie").withColumn("_place", place))
    at = F.shiftright("_place", 33)
    counts = ranged.groupBy(at.alias("_range")).agg(F.count(F.lit(1)).alias("_count"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_range", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_first"))
    numbered = ranged.withColumn("_range", at).join(F.broadcast(first), "_range")  # one row a partition of the shuffle
    return numbered.withColumn(out, F.col("_first") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_range", "_first", "_place")


def _first_seen(df: DataFrame, field: Column, order_by: Column) -> DataFrame:
    return df.select(field.alias("_value"), order_by.alias("_order")).where("_value is not null").groupBy("_value").agg(F.min("_order").alias("_order"))


def autonumber(df: DataFrame, field: Column, out: str, order_by: Column) -> DataFrame:
    """W4 (own choice): a number from 1 for each distinct value, in order of first appearance; null for null."""
    numbers = row_numbers(_first_seen(df, field, order_by), "_number", ["_order", "_value"]).select("_value", "_number")
    return df.withColumn("_key", field).join(numbers, F.col("_key") == F.col("_value"), "left").drop("_key", "_value").withColumnRenamed("_number", out)


def autonumber_stored(df: DataFrame, field: Column, out: str, order_by: Column, path: str) -> DataFrame:
    """W4 (own choice): autonumber with numbers that stay from load to load: a dictionary of values, published at path, which each load extends.

    Values that the dictionary has keep their numbers; new ones get the next, in order of first appearance. Of loads that extend it
    at once one wins, and the others raise an error before they change anything, and can be run again.
    """
    spark = df.sparkSession
    known = published(spark, path) if current(spark, path) else None
    seen = _first_seen(df, field, order_by)
    fresh = seen if known is None else seen.join(known, "_value", "left_anti")
    most = 0 if known is None else known.agg(F.coalesce(F.max("_number"), F.lit(0))).first()[0]
    numbers = row_numbers(fresh, "_number", ["_order", "_value"]).select("_value", (F.col("_number") + most).alias("_number"))
    if known is None or not numbers.isEmpty():
        with claimed(spark, path):
            publish(numbers if known is None else known.unionByName(numbers), path)
    numbers = published(spark, path)
    return df.withColumn("_key", field).join(numbers, F.col("_key") == F.col("_value"), "left").drop("_key", "_value").withColumnRenamed("_number", out)


def field_value(df: DataFrame, field: Column, n: int, order_by: Column) -> DataFrame:
    """W3 (own choice): one row `value`: the n-th distinct value by first appearance (n from 1); no row beyond the last."""
    ranked = row_numbers(_first_seen(df, field, order_by), "_number", ["_order", "_value"])
    return ranked.where(F.col("_number") == n).select(F.col("_value").alias("value"))


def iterno(df: DataFrame, times: Column, out: str = "iterno") -> DataFrame:
    """W6 (own choice): each row `times` times, with the number of the repetition from 1; none for null or less than 1."""
    return df.where(times >= 1).withColumn(out, F.explode(F.sequence(F.lit(1), times.cast("int"))))


def top_k(df: DataFrame, score: Column, k: int, then: list) -> DataFrame:
    """The k rows with the greatest score, ties by `then`; each task hands on k rows."""
    return df.orderBy(score.desc(), *then).limit(k)


def first_rows(df: DataFrame, n: int, order_by: list) -> DataFrame:
    """The first n rows in the order."""
    return df.orderBy(*order_by).limit(n)
