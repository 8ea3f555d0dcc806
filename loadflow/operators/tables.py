"""Table algebra of a load pipeline: natural joins, keep, concatenate, and a registry of named tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadflow.sources.shared import spread, written

JOIN_KINDS = ("inner", "left", "right", "full")


def quoted(name: str) -> Column:
    """A column by its exact name, whatever blanks or dots that holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def select(df: DataFrame, *fields: str, **computed: Column) -> DataFrame:
    """Bare columns in order, then computed ones under their names. No field at all: every column."""
    bare = [quoted(f).alias(f) for f in fields] or ([] if computed else [quoted(c) for c in df.columns])
    return df.select(*bare, *[c.alias(name) for name, c in computed.items()])


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """New names for columns; a name that isn't there raises ValueError."""
    known = {c.lower() for c in df.columns}
    if missing := [n for n in names if n.lower() not in known]:
        raise ValueError(f"no column {missing[0]}")
    return df.withColumnsRenamed(names)


def drop_fields(df: DataFrame, *names: str) -> DataFrame:
    """Without these columns; names that aren't there are no error."""
    return df.drop(*names)


def load_distinct(df: DataFrame, *fields: str) -> DataFrame:
    """U4: distinct rows of the fields, projected first so that only these are shuffled."""
    return select(df, *fields).distinct()


def shared_columns(left: DataFrame, right: DataFrame) -> list[str]:
    """Columns that both have, without regard to case, in the left one's order and spelling."""
    other = {c.lower() for c in right.columns}
    return [c for c in left.columns if c.lower() in other]


def _spelled_like(left: DataFrame, right: DataFrame) -> DataFrame:
    own = {c.lower(): c for c in left.columns}
    return right.withColumnsRenamed({c: own[c.lower()] for c in right.columns if c.lower() in own and own[c.lower()] != c})


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner", allow_cross: bool = False) -> DataFrame:
    """Join on all shared columns, each of which comes out once (coalesced in a full join).

    Keys that are null never match. Without a shared column it raises ValueError, unless allow_cross asks
    for all pairs.
    """
    if how not in JOIN_KINDS:
        raise ValueError(f"join kind {how!r}: one of {', '.join(JOIN_KINDS)}")
    keys = shared_columns(left, right)
    if not keys:
        if not allow_cross:
            raise ValueError("no shared column to join on")
        return left.crossJoin(right)
    return left.join(_spelled_like(left, right), keys, how)


def hot_keys(df: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Distinct keys that hold more than about `share` of df's rows (a few with less may be among them); 1 / share at most.

    A sketch of frequent items over hashes of the keys, in one pass without a shuffle; then the keys with such a hash.
    """
    hashed = df.select(F.xxhash64(*map(quoted, keys)).alias("_h"), *map(quoted, keys)).where(_no_nulls(keys))
    frequent = hashed.select("_h").stat.freqItems(["_h"], share).first()
    return hashed.where(F.col("_h").isin(list(frequent[0] or []) if frequent else [])).select(*map(quoted, keys)).distinct()


def _no_nulls(keys: list[str]) -> Column:
    return reduce(Column.__and__, [quoted(k).isNotNull() for k in keys])


def skewed_join(left: DataFrame, right: DataFrame, how: str = "inner", share: float | None = None, salts: int | None = None) -> DataFrame:
    """J2-J5 for keys that hold a large part of a table: the rows of natural_join, with hot keys dealt over many tasks.

    A key is hot in a table with more than `share` of its rows (default: those of a quarter of a shuffle partition). Rows of the table in which it is hot get one of
    `salts` numbers, and the other table's rows of that key come once with each. A key that is hot in both is salted in left alone. Rows with a
    null in their key match nothing: those that the join keeps go past the shuffle. Hot keys are found when this is called, in one pass over each
    table; they are 2 / share at most, and so are broadcast.
    """
    keys = shared_columns(left, right)
    if not keys or how not in JOIN_KINDS:
        return natural_join(left, right, how)
    spark = left.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share, salts = share or 1 / (4 * parts), salts or parts
    right = _spelled_like(left, right)
    lefts, rights = [written(hot_keys(df, keys, share)) for df in (left, right)]
    hot = lefts.withColumn("_in", F.lit("left")).unionByName(rights.join(lefts, keys, "left_anti").withColumn("_in", F.lit("right")))
    hot = written(hot)

    def salted(df: DataFrame, side: str) -> DataFrame:
        df = df.withColumn("_tie", spread(df)).where(_no_nulls(keys)).join(F.broadcast(hot), keys, "left")
        one = F.array(F.pmod("_tie", F.lit(salts)).cast("int"))
        copies = F.when(F.col("_in") == side, one).when(F.col("_in").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        return df.withColumn("_salt", F.explode(copies)).drop("_tie")

    a = salted(left, "left").withColumnRenamed("_in", "_hot_l").withColumn("_l", F.lit(True))
    b = salted(right, "right").withColumnRenamed("_in", "_hot_r").withColumn("_r", F.lit(True))
    out = a.join(b, [*keys, "_salt"], how)
    # A copy without a partner says nothing: a key that is hot in the other table has partners there, at other salts.
    copied_l, copied_r = F.col("_r").isNull() & (F.col("_hot_l") == "right"), F.col("_l").isNull() & (F.col("_hot_r") == "left")
    out = out.where(~F.coalesce(copied_l, F.lit(False)) & ~F.coalesce(copied_r, F.lit(False)))
    names = [*keys, *[c for c in left.columns if c not in keys], *[c for c in right.columns if c not in keys]]
    out = out.select(*map(quoted, names))
    for df, kinds in ((left, ("left", "full")), (right, ("right", "full"))):
        if how in kinds:
            out = out.unionByName(df.where(~_no_nulls(keys)), allowMissingColumns=True)
    return out


def join_all(base: DataFrame, joins: Iterable[tuple[DataFrame, str]]) -> DataFrame:
    """Several natural joins on one base in order; each sees the columns that those before it brought."""
    for right, how in joins:
        base = natural_join(base, right, how)
    return base


def keep(left: DataFrame, right: DataFrame, how: str = "inner", merge: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both tables, reduced and not merged: left keep reduces right, right keep reduces left, inner keep both.

    merge gives the merging inner join as both results, for scripts that rely on it.
    """
    if merge:
        both = natural_join(left, right, "inner")
        return both, both
    keys = shared_columns(left, right)
    if not keys:
        raise ValueError("no shared column to keep by")
    if how not in ("left", "right", "inner"):
        raise ValueError(f"keep kind {how!r}")
    spelled = _spelled_like(left, right)
    new_left = left if how == "left" else left.join(spelled.select(*map(quoted, keys)), keys, "left_semi").select(*map(quoted, left.columns))
    new_right = spelled if how == "right" else spelled.join(left.select(*map(quoted, keys)), keys, "left_semi").select(*map(quoted, spelled.columns))
    return new_left, new_right.toDF(*right.columns)


def concatenate(base: DataFrame, *more: DataFrame) -> DataFrame:
    """Rows of all tables, aligned by name without regard to case; what a table lacks is null."""
    for df in more:
        base = base.unionByName(_spelled_like(base, df), allowMissingColumns=True)
    return base


class Tables:
    """Named tables of one job, in the order of their loads."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._tables: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        return self._tables[self._key(name)]

    def __contains__(self, name: str) -> bool:
        return any(k.lower() == name.lower() for k in self._tables)

    def _key(self, name: str) -> str:
        found = [k for k in self._tables if k.lower() == name.lower()]
        if not found:
            raise KeyError(f"no table {name}")
        return found[0]

    @property
    def names(self) -> list[str]:
        return list(self._tables)

    def load(self, name: str, df: DataFrame, noconcatenate: bool = False) -> DataFrame:
        """A load under a known name with the same columns appends; noconcatenate replaces; other columns are an error."""
        if name in self and not noconcatenate:
            old = self[name]
            if {c.lower() for c in old.columns} != {c.lower() for c in df.columns}:
                raise ValueError(f"table {name} has other columns; use concatenate() or noconcatenate")
            df = concatenate(old, df)
        key = self._key(name) if name in self else name
        self._tables.pop(key, None)
        self._tables[key] = df
        df.createOrReplaceTempView(key)
        return df

    def _put(self, key: str, df: DataFrame) -> DataFrame:
        self._tables[key] = df
        df.createOrReplaceTempView(key)
        return df

    def join(self, df: DataFrame, how: str = "inner", into: str | None = None) -> DataFrame:
        """Joined into a named table, or else into the one loaded last."""
        key = self._key(into) if into else self.names[-1]
        return self._put(key, natural_join(self._tables[key], df, how))

    def concatenate(self, df: DataFrame, into: str | None = None) -> DataFrame:
        key = self._key(into) if into else self.names[-1]
        return self._put(key, concatenate(self._tables[key], df))

    def rename_table(self, old: str, new: str) -> None:
        """P8."""
        df = self._tables.pop(key := self._key(old))
        self.spark.catalog.dropTempView(key)
        self._put(new, df)

    def drop(self, *names: str) -> None:
        """S16."""
        for name in names:
            key = self._key(name)
            self._tables.pop(key).unpersist()
            self.spark.catalog.dropTempView(key)


def choose(value: object, branches: dict[object, Callable[[], DataFrame]], default: Callable[[], DataFrame] | None = None) -> DataFrame:
    """The branch of a job parameter; only the chosen one is built."""
    build = branches.get(value, default)
    if build is None:
        raise ValueError(f"no branch for {value!r}")
    return build()
