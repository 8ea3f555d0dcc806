"""Typed landing of raw text, and incremental rebuilds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loadflow.operators.tables import quoted
from loadflow.sources.publish import Folder, replace_folder
from loadflow.sources.shared import written

# What a column's name says about its type, in the order in which it is asked: words, where they may stand, type.
NAME_RULES = (
    (("date", "_dt", "dob"), "within", "date"),
    (("timestamp", "_ts", "datetime", "created", "updated"), "within", "timestamp_ntz"),
    (("amount", "amt", "price", "cost", "value", "sales", "revenue", "qty", "quantity", "rate", "pct"), "within", "decimal(38,4)"),
    (("id", "_key"), "end", "string"),
    (("key",), "all", "string"),
    (("flag", "is_", "has_"), "within", "boolean"),
)
_STANDS = {"within": str.__contains__, "end": str.endswith, "all": str.__eq__}


def type_for(name: str) -> str:
    """The Spark type that a column's name suggests; text if nothing does."""
    return next((kind for words, where, kind in NAME_RULES if any(_STANDS[where](name.lower(), w) for w in words)), "string")


def _types(raw: DataFrame, overrides: dict[str, str] | None) -> dict[str, str]:
    return {c: (overrides or {}).get(c, type_for(c)) for c in raw.columns}


def land(raw: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """Raw text columns in the types of their names; what doesn't fit is null. overrides: types of single columns."""
    return raw.select(*[F.col(f"`{c}`").try_cast(t).alias(c) for c, t in _types(raw, overrides).items()])


def failed_casts(raw: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """Col, type, n_failed (values that became null), in one pass over raw."""
    types = _types(raw, overrides)
    counts = [F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(t).isNull()) for c, t in types.items()]
    rows = F.array(*[F.struct(F.lit(c).alias("col"), F.lit(t).alias("type"), n.alias("n_failed")) for (c, t), n in zip(types.items(), counts, strict=True)])
    return raw.agg(rows.alias("r")).select(F.inline("r"))


def one_per_key(df: DataFrame, keys: list[str], version: Column | None = None) -> DataFrame:
    """One row of each key, null being a key like any other: the one of the greatest version, of equal ones that of the greatest digest.

    A partial aggregate: a key that holds a large part of all rows leaves each task as one row.
    """
    order = F.struct(*([version.alias("_v")] if version is not None else []), digest(df, df.columns).alias("_d"))
    held = df.groupBy(*[quoted(k) for k in keys]).agg(F.max_by(F.struct(*[quoted(c) for c in df.columns]), order).alias("_row"))
    return held.select("_row.*")


def digest(df: DataFrame, columns: list[str]) -> Column:
    """128 bits of some columns; null differs from everything else."""
    own = [x for c in columns for x in (quoted(c), quoted(c).isNull())]
    return F.struct(F.xxhash64(*own).alias("a"), F.xxhash64(F.lit(1), *own).alias("b"))


def _same_key(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    pairs = [left[f"`{k}`"].eqNullSafe(right[f"`{k}`"]) for k in keys]
    return reduce(Column.__and__, pairs)


def append_new(history: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """History, and of the fresh rows one for each key that it lacks. Null is a key like any other, so that it comes in once."""
    known = history.select(*[quoted(k).alias(k) for k in keys])
    fresh = one_per_key(fresh, keys)
    return history.unionByName(fresh.join(known, _same_key(fresh, known, keys), "left_anti"), allowMissingColumns=True)


def latest(df: DataFrame, keys: list[str], version: list) -> DataFrame:
    """The row of each key that comes first in the order `version` (newest first).

    Spark keeps one row a key in each task before the shuffle (a limit inside of the window's groups), so that a hot key is no hot task.
    """
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*version))).where("_n = 1").drop("_n")


def changes(stored: DataFrame, fresh: DataFrame, keys: list[str], complete: bool = False) -> DataFrame:
    """Keys and `kind` of what differs: new, changed, or, where fresh is the complete table, deleted.

    Only keys and 128-bit digests of the rows are joined, null keys with null keys; both tables have a row a key.
    """
    columns = fresh.columns
    side = lambda df, name: df.select(F.struct(*[quoted(k).alias(k) for k in keys]).alias("_key"), digest(df, columns).alias(name))
    s, f = side(stored, "_old"), side(fresh, "_new")
    both = s.join(f, s["_key"].eqNullSafe(f["_key"]), "full" if complete else "right")
    kind = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "changed")
    return both.select(F.coalesce(f["_key"], s["_key"]).alias("_key"), kind.alias("kind")).where("kind is not null").select("_key.*", "kind")


def merge(spark: SparkSession, path: str, fresh: DataFrame, keys: list[str], partition_by: list[str], complete: bool = False, version: Column | None = None) -> DataFrame:
    """Fresh rows into a stored table: new keys come in, changed ones are replaced, and only partitions that change are read and written.

    The table is Parquet by the columns partition_by, made by the first merge. A key stays in its partition (an order's date doesn't change);
    in another one it is another key. Of several fresh
    rows of a key the one of the greatest version counts. complete: fresh has all keys of the partitions that it names, so
    that others there are deleted. Gives keys and kinds of all changes, as a written table.

    First digests of the partitions that fresh names are compared; then those with a change are written elsewhere and take their places
    by Spark's dynamic overwrite, so that a failed merge can be run again. The partitions' values are collected: a row for each.
    """
    own = list(dict.fromkeys([*keys, *partition_by]))
    fresh = written(one_per_key(fresh, own, version).select(*[quoted(c).alias(c) for c in fresh.columns]))
    folder = Folder(spark, path)
    if not folder.exists():
        made = written(fresh.select(*keys).withColumn("kind", F.lit("new")))
        replace_folder(fresh, path, partition_by)
        return made
    stored = spark.read.schema(fresh.schema).parquet(path)
    parts = [quoted(p) for p in partition_by]

    def only(df: DataFrame, values: DataFrame) -> DataFrame:
        """The partitions with these values, as literals, which prune the scan."""
        rows = values.select(*parts).distinct().collect()
        match = [reduce(Column.__and__, [c.eqNullSafe(F.lit(v)) for c, v in zip(parts, r, strict=True)]) for r in rows]
        return df.where(reduce(Column.__or__, match) if match else F.lit(False))

    named = only(stored, fresh)
    found = written(changes(named, fresh, own, complete))
    touched = only(stored, found)
    f = fresh.select(*[quoted(c).alias(c) for c in fresh.columns])
    gone = found.select(*[quoted(c).alias(c) for c in own])
    coming = found.where("kind <> 'deleted'").select(*[quoted(c).alias(c) for c in own])
    kept = touched.join(gone, _same_key(touched, gone, own), "left_anti")
    rows = written(kept.unionByName(f.join(coming, _same_key(f, coming, own), "left_semi")))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
    left = rows.select(*parts).distinct()
    empty = found.select(*parts).distinct().join(left, _same_key(found, left, partition_by), "left_anti").collect() if complete else []
    for r in empty:  # dynamic overwrite leaves a partition that has no row any more
        only_there = only(stored, spark.createDataFrame([r], fresh.select(*parts).schema))
        for name in {x.rpartition("/")[0] for x in only_there.inputFiles()}:
            Folder(spark, name).delete()
    return found.select(*keys, "kind")
