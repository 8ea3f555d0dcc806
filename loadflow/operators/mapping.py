"""Mapping tables and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def build_map(df: DataFrame, key: Column | str, value: Column | str, order: Column | str | None = None) -> DataFrame:
    """mapped_key, mapped_value with one row for each key: the value that comes first by `order`, or the least value.

    Null keys are left out, as no lookup finds them.
    """
    key = F.col(key) if isinstance(key, str) else key
    value = F.col(value) if isinstance(value, str) else value
    pairs = df.select(key.alias("mapped_key"), value.alias("mapped_value"), (value if order is None else F.col(order) if isinstance(order, str) else order).alias("_order"))
    first = F.min("mapped_value") if order is None else F.min_by("mapped_value", F.struct("_order", "mapped_value"))
    return pairs.where("mapped_key is not null").groupBy("mapped_key").agg(first.alias("mapped_value"))


def apply_map(df: DataFrame, mapping: DataFrame, key: Column | str, out: str, default: Column | object = None) -> DataFrame:
    """Df with the mapped value of key as column `out`; default where there is none or it is null. Rows never multiply.

    Spark broadcasts the map if its size allows, and else joins by a shuffle.
    """
    key = F.col(key) if isinstance(key, str) else key
    m = mapping.select(F.col("mapped_key").alias("_mapped_key"), F.col("mapped_value").alias("_mapped_value"))
    value = F.col("_mapped_value")
    if default is not None:
        value = F.coalesce(value, default if isinstance(default, Column) else F.lit(default))
    return df.withColumn("_lookup_key", key).join(m, F.col("_lookup_key") == F.col("_mapped_key"), "left").withColumn(out, value).drop("_lookup_key", "_mapped_key", "_mapped_value")
