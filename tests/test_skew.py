"""Hot keys, ties and null keys: no task gets much more than the others."""

import itertools
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loadflow.operators import ordered, tables
from loadflow.sources.shared import written


def sizes(df):
    """Rows of each task of the last stage."""
    return sorted(r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())


@pytest.fixture
def parts(spark):
    """Eight tasks a shuffle, none of them merged, and no broadcast join chosen by size."""
    held = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield 8
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def files(monkeypatch):
    """Rows of each file of the tables that row_numbers writes: one of each task."""
    found, write = [], ordered.written

    def seen(df):
        out = write(df)
        found.append(sorted(r["count"] for r in out.groupBy(F.input_file_name().alias("f")).count().collect()))
        return out

    monkeypatch.setattr(ordered, "written", seen)
    return found


@pytest.mark.parametrize("value", ["one", "few"])
def test_ties_are_numbered_by_all_tasks(spark, parts, files, value):
    n = 400_000
    df = spark.range(0, n, 1, 8).select((F.lit(1) if value == "one" else F.col("id") % 3).cast("int").alias("o"), "id")
    numbered = written(ordered.row_numbers(df, "n", ["o"]))
    assert numbered.agg(F.count_distinct("n"), F.min("n"), F.max("n"), F.count_distinct("id")).first()[:] == (n, 1, n, n)
    assert numbered.select("o", F.lag("o").over(Window.orderBy("n")).alias("b")).where("o < b").isEmpty()
    assert len(files[0]) == 8 and files[0][-1] <= 2 * files[0][4]


def test_equal_rows_are_numbered_by_several_tasks(spark, parts, files):
    df = spark.range(0, 80_000, 1, 16).select(F.lit(None).cast("string").alias("o"), F.lit("x").alias("v"))
    numbered = ordered.row_numbers(df, "n", ["o"])
    assert numbered.agg(F.count_distinct("n"), F.max("n")).first()[:] == (80_000, 80_000)
    assert len(files[0]) > 4 and files[0][-1] <= 80_000 // 3


LEFT = [(1, "a", "p"), (1, "a", "q"), (2, "b", "r"), (None, "b", "s"), (3, None, "t"), (None, None, "u"), (9, "z", "v")] + [(5, "h", f"l{i}") for i in range(60)] + [(6, "h", "l")] + [(8, "both", f"m{i}") for i in range(40)]
RIGHT = [(1, "a", 1), (2, "b", 2), (2, "b", 3), (None, "b", 4), (3, None, 5), (5, "h", 6), (5, "h", 7), (7, "only", 8)] + [(6, "h", i) for i in range(60)] + [(8, "both", i) for i in range(30)]


@pytest.mark.parametrize("how", tables.JOIN_KINDS)
def test_skewed_join_equals_natural_join(spark, how):
    left, right = spark.createDataFrame(LEFT, "`k 1` int, k2 string, l string"), spark.createDataFrame(RIGHT, "`K 1` int, K2 string, r int")
    want = tables.natural_join(left, right, how)
    for share, salts in itertools.product((0.05, 0.3, 0.9), (1, 3, 8)):
        got = tables.skewed_join(left, right, how, share, salts)
        assert got.columns == want.columns == ["k 1", "k2", "l", "r"]
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect())), (share, salts)


@pytest.mark.parametrize("how", ["left", "full", "right"])
def test_hot_and_null_keys_leave_no_hot_task(spark, parts, how):
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, None).otherwise(F.col("id"))
    left = written(spark.range(0, 120_000, 1, 8).select(key.alias("k"), F.col("id").alias("l")))
    right = written(spark.range(0, 120_000, 1, 8).select(F.col("id").alias("k"), (F.col("id") * 2).alias("r")))
    joined = tables.skewed_join(left, right, how)
    assert joined.count() == tables.natural_join(left, right, how).count()
    tasks = sizes(joined.where("k is not null"))
    assert len(tasks) >= 8 and tasks[-1] <= 2 * tasks[len(tasks) // 2]
    plain = sizes(tables.natural_join(left, right, how))
    assert plain[-1] > 2 * plain[len(plain) // 2]


def test_hot_keys_are_few(spark):
    df = spark.range(10_000).select(F.when(F.col("id") % 4 == 0, -1).otherwise(F.col("id")).alias("k"))
    found = [r["k"] for r in tables.hot_keys(df, ["k"], 0.1).collect()]
    assert -1 in found and len(found) <= 10
    assert tables.hot_keys(df.where("false"), ["k"], 0.1).count() == 0
