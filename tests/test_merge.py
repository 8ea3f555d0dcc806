"""Incremental merges: what comes in, what goes, and what is read."""

import os
import random

from pyspark.sql import functions as F

from loadflow.sources import landing

SCHEMA = "k int, v string, day string"


def read(spark, path):
    return sorted((tuple(r) for r in spark.read.schema(SCHEMA).parquet(path).select("k", "v", "day").collect()), key=str)


def stamps(path):
    return {d: sorted((f, os.stat(f"{path}/{d}/{f}").st_mtime_ns) for f in os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("day=")}


def test_null_keys_come_in_once(spark):
    old = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    fresh = spark.createDataFrame([(1, "b"), (2, "c"), (2, "c"), (2, "d"), (None, "m")], "k int, v string")
    once = landing.append_new(old, fresh, ["k"])
    assert sorted(r[0] for r in once.where("k is not null").collect()) == [1, 2] and once.where("k is null").count() == 1
    assert sorted(landing.append_new(once, fresh, ["k"]).collect(), key=str) == sorted(once.collect(), key=str)
    first = landing.append_new(old.where("k = 1"), fresh, ["k"])
    assert sorted((tuple(r) for r in first.collect()), key=str)[0] == (1, "a") and first.count() == 3


def test_latest_keeps_one_row_a_task(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    out = landing.latest(df, ["k"], [F.desc("v")])
    assert sorted(map(tuple, out.collect())) == [(0, 998), (1, 999)] and "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(landing.one_per_key(df, ["k"], F.col("v")).collect()) == sorted(out.collect())


def test_merge_changes_only_what_it_must(spark, tmp_path):
    path = f"{tmp_path}/t"
    first = [(1, "a", "d1"), (2, "b", "d1"), (3, "c", "d2"), (None, "n", "d2"), (4, "e", "d3"), (5, "f", None)]
    assert landing.merge(spark, path, spark.createDataFrame(first, SCHEMA), ["k"], ["day"]).count() == 6
    assert read(spark, path) == sorted(first, key=str)
    before = stamps(path)
    fresh = [(1, "a", "d1"), (2, "B", "d1"), (2, "A", "d1"), (6, "g", "d1"), (None, "n", "d2"), (3, "c", "d2"), (5, "F", None)]
    made = landing.merge(spark, path, spark.createDataFrame(fresh, SCHEMA), ["k"], ["day"], version=F.col("v"))
    assert sorted(map(tuple, made.collect()), key=str) == sorted([(2, "changed"), (6, "new"), (5, "changed")], key=str)
    assert read(spark, path) == sorted([(1, "a", "d1"), (2, "B", "d1"), (6, "g", "d1"), (3, "c", "d2"), (None, "n", "d2"), (4, "e", "d3"), (5, "F", None)], key=str)
    after = stamps(path)
    assert after["day=d2"] == before["day=d2"] and after["day=d3"] == before["day=d3"] and after["day=d1"] != before["day=d1"]
    again = landing.merge(spark, path, spark.createDataFrame(fresh, SCHEMA), ["k"], ["day"], version=F.col("v"))
    assert again.count() == 0 and stamps(path) == after  # the same load again changes nothing


def test_merge_of_complete_partitions_deletes(spark, tmp_path):
    path = f"{tmp_path}/t"
    landing.merge(spark, path, spark.createDataFrame([(1, "a", "d1"), (2, "b", "d1"), (3, "c", "d2"), (4, "d", "d2")], SCHEMA), ["k"], ["day"])
    made = landing.merge(spark, path, spark.createDataFrame([(1, "a", "d1"), (9, "z", "d9")], SCHEMA), ["k"], ["day"], complete=True)
    assert sorted(map(tuple, made.collect())) == [(2, "deleted"), (9, "new")]
    assert read(spark, path) == [(1, "a", "d1"), (3, "c", "d2"), (4, "d", "d2"), (9, "z", "d9")]


def test_untouched_partitions_are_not_read(spark, tmp_path):
    path = f"{tmp_path}/t"
    days = [f"d{i}" for i in range(6)]
    landing.merge(spark, path, spark.createDataFrame([(i, "v", days[i % 6]) for i in range(60)], SCHEMA), ["k"], ["day"])
    for d in days[1:]:  # whoever reads these fails
        for f in os.listdir(f"{path}/day={d}"):
            if f.endswith(".parquet"):
                with open(f"{path}/day={d}/{f}", "wb") as out:
                    out.write(b"not Parquet")
                crc = f"{path}/day={d}/.{f}.crc"
                if os.path.exists(crc):
                    os.remove(crc)
    made = landing.merge(spark, path, spark.createDataFrame([(0, "w", "d0"), (100, "x", "d0")], SCHEMA), ["k"], ["day"])
    assert sorted(map(tuple, made.collect())) == [(0, "changed"), (100, "new")]
    assert spark.read.schema(SCHEMA).parquet(f"{path}/day=d0").count() == 11


def test_merges_equal_a_dictionary(spark, tmp_path):
    rnd, path, want = random.Random(6), f"{tmp_path}/t", {}
    for _ in range(4):
        load = {(rnd.choice([None, *range(30)]), rnd.choice("ab")): rnd.choice("xyz") for _ in range(25)}
        want.update(load)
        landing.merge(spark, path, spark.createDataFrame([(k, v, d) for (k, d), v in load.items()], SCHEMA), ["k"], ["day"])
        assert read(spark, path) == sorted([(k, v, d) for (k, d), v in want.items()], key=str)
