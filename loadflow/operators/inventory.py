"""Inventory, effort, retrieval and reconciliation over tables of metadata and data."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage(columns: DataFrame) -> DataFrame:
    """M6: per script: tables, fields, flagged fields, and the share in per cent that needs no review (100 without fields)."""
    agg = columns.groupBy("script").agg(F.count_distinct("tbl").alias("n_tables"), F.count("col").alias("n_fields"), F.count_if((F.col("n_warnings") > 0) & F.col("col").isNotNull()).alias("n_flagged"))
    share = F.round((100 * (F.col("n_fields") - F.col("n_flagged")) / F.nullif("n_fields", F.lit(0))).cast("double"), 1)
    return agg.withColumn("auto_pct", F.coalesce(share, F.lit(100.0)))


def by_layer(columns: DataFrame) -> DataFrame:
    """M6: tables and fields by layer and kind."""
    return columns.groupBy("layer", "kind").agg(F.count_distinct("script", "tbl").alias("n_tables"), F.count("col").alias("n_fields"))


def effort(columns: DataFrame, joins: DataFrame) -> DataFrame:
    """M7: script, tbl, score = 0.2 a field + 2 a join + 3 a warning + 2 if grouped; Low below 5, Medium below 12, else High.

    Joins find their tables without regard to case, as lineage does.
    """
    a = columns.groupBy("script", "tbl").agg(F.count("col").alias("fields"), F.sum("n_warnings").alias("reviews"), F.max("grouped").alias("grouped"))
    a = a.withColumn("_t", F.lower("tbl"))
    b = joins.groupBy("script", F.lower("base_tbl").alias("_t")).agg(F.count(F.lit(1)).alias("joins"))
    score = F.col("fields") * 0.2 + F.coalesce("joins", F.lit(0)) * 2 + F.coalesce("reviews", F.lit(0)) * 3 + F.when(F.col("grouped"), 2).otherwise(0)
    df = a.join(b, ["script", "_t"], "left").withColumn("score", F.round(score.cast("double"), 1))
    return df.select("script", "tbl", "score", F.when(F.col("score") < 5, "Low").when(F.col("score") < 12, "Medium").otherwise("High").alias("effort"))


def keyword_score(text: Column, query: str) -> Column:
    """M8: how often the distinct words of a query (letters, digits and _; two characters at least) stand in the lower-cased text."""
    score, low = F.lit(0), F.lower(F.coalesce(text, F.lit("")))
    for t in dict.fromkeys(w.lower() for w in re.findall(r"[A-Za-z_]\w+", query)):
        score = score + ((F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t)).cast("int")
    return score


def retrieve(df: DataFrame, text: str, query: str, k: int, then: str) -> DataFrame:
    """M8: the k rows with the greatest score above 0, ties by `then`; if no row has one, the first k rows by `then`.

    The choice is part of the plan: rows below the best come after, and go if any row has a score.
    """
    scored = df.withColumn("score", keyword_score(F.col(text), query))
    best = scored.orderBy(F.desc("score"), then).limit(k)
    return best.withColumn("_top", F.max("score").over(_all())).where((F.col("score") > 0) | (F.col("_top") == 0)).drop("_top")


def _all():
    from pyspark.sql.window import Window

    return Window.partitionBy(F.lit(1))  # k rows at most


def reconcile(pairs: dict[str, tuple[DataFrame, DataFrame]], measures: dict[str, str] | None = None) -> DataFrame:
    """M9: name, source_rows, target_rows, and source_sum, target_sum of a measure where one is named for the table."""
    out = None
    for name, sides in pairs.items():
        for side, df in zip(("source", "target"), sides, strict=True):
            m = (measures or {}).get(name)
            total = F.sum(F.col(m).cast("decimal(38,4)")) if m else F.lit(None).cast("decimal(38,4)")
            own = df.agg(F.count(F.lit(1)).alias("n"), total.cast("decimal(38,4)").alias("s")).select(F.lit(name).alias("name"), F.lit(side).alias("side"), "n", "s")
            out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("nothing to reconcile")
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    return out.groupBy("name").agg(of("source", "n").alias("source_rows"), of("target", "n").alias("target_rows"), of("source", "s").alias("source_sum"), of("target", "s").alias("target_sum"))


def catalog_text(columns: DataFrame) -> DataFrame:
    """Script, tbl, text: one searchable record of a table, a line for each of its columns in order."""
    line = F.concat(F.col("tbl"), F.lit("."), F.col("col"), F.lit(" = "), F.coalesce("expr", F.lit("")))
    rows = columns.select("script", "tbl", F.struct("pos", line.alias("line")).alias("x"))
    return rows.groupBy("script", "tbl").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), "\n").alias("text"))
