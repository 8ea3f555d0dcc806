"""Statistics as mergeable states: a table of sketches a day, merged over days without the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadflow.operators.tables import quoted

#: Sizes of the sketches. A quantile of the KLL state is off by about 0.2 % of the rows in rank, a number of distinct values by about 0.8 % (standard error).
KLL_K, HLL_LOG_K = 2048, 14
#: What the tests and queries allow: some four times that.
RANK_ERROR, DISTINCT_ERROR = 0.01, 0.04


def sketched(df: DataFrame, by: list[str], number: Column, item: Column) -> DataFrame:
    """By, n (rows with a number), low, high, quantiles and items: states over a group's numbers and its distinct items.

    States are binary columns of some kilobytes whatever the group's size, built by partial aggregates, so that such a table can
    be stored for each day. Nulls don't count; a group without a number (item) has a null state.
    """
    x, v = number.cast("double"), item.cast("string")
    return df.groupBy(*map(quoted, by)).agg(
        F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"),
        F.when(F.count(x) > 0, F.kll_sketch_agg_double(x, F.lit(KLL_K))).alias("quantiles"), F.when(F.count(v) > 0, F.hll_sketch_agg(v, F.lit(HLL_LOG_K))).alias("items"),
    )


def merged(states: DataFrame, by: list[str]) -> DataFrame:
    """States of coarser groups from a table of sketched(): the same as of all their rows, within the sketches' errors."""
    return states.groupBy(*map(quoted, by)).agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.when(F.count("quantiles") > 0, F.kll_merge_agg_double("quantiles")).alias("quantiles"), F.when(F.count("items") > 0, F.hll_union_agg("items")).alias("items"),
    )


def read_off(states: DataFrame, wanted: dict[str, float], distinct: str = "n_distinct") -> DataFrame:
    """states with a quantile for each entry of wanted (name: p) and the number of distinct items, in place of the states; the ends (p 0 and 1) are exact."""
    at = lambda p: F.col("low") if p <= 0 else F.col("high") if p >= 1 else F.kll_sketch_get_quantile_double("quantiles", F.lit(float(p)))
    found = [F.when(F.col("quantiles").isNotNull(), at(p)).alias(name) for name, p in wanted.items()]
    by = [quoted(c) for c in states.columns if c not in ("low", "high", "quantiles", "items")]
    return states.select(*by, *found, F.coalesce(F.hll_sketch_estimate("items"), F.lit(0)).alias(distinct))
