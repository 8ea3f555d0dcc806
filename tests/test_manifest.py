"""Loads of files that have come since the last one."""

import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadflow.sources import manifest


def ids(added):
    return sorted(r["id"] for r in added.rows.collect()) if added.rows is not None else []


def test_second_run_reads_only_added_files(spark, tmp_path):
    folder, path = f"{tmp_path}/in", f"{tmp_path}/manifest"
    spark.range(3).write.parquet(f"{folder}/a")
    one = manifest.load_added(spark, folder, path)
    assert ids(one) == [0, 1, 2]
    assert ids(manifest.load_added(spark, folder, path)) == [0, 1, 2]  # not done yet
    one.done()
    again = manifest.load_added(spark, folder, path)
    assert again.rows is None and again.files.count() == 0
    again.done()
    spark.range(3, 5).withColumn("extra", F.lit("x")).write.parquet(f"{folder}/b/deep")
    two = manifest.load_added(spark, folder, path, "file")
    assert ids(two) == [3, 4] and two.rows.columns == ["id", "extra", "file"]
    assert all("/b/deep/" in f for f in two.rows.inputFiles())
    two.done()
    name = next(f for f in os.listdir(f"{folder}/a") if f.endswith(".parquet"))
    os.utime(f"{folder}/a/{name}", (time.time() + 60, time.time() + 60))  # written anew
    assert manifest.load_added(spark, folder, path).files.count() == 1


def test_columns_drift(spark, tmp_path):
    folder = f"{tmp_path}/in"
    spark.sql("select 1 as id, 1 as n, date'2026-01-01' as d, 5 as t, 1.5 as m").write.parquet(f"{folder}/a")
    spark.sql("select 2 as ID, 2L as n, timestamp_ntz'2026-01-02 03:04:05' as d, 'x' as t, 7L as m, true as more").write.parquet(f"{folder}/b")
    spark.sql("select 3 as id, 2.5D as n, cast(null as date) as d, 6 as t, 2.25 as m").write.parquet(f"{folder}/c")
    added = manifest.load_added(spark, folder, f"{tmp_path}/m")
    assert {f.name: f.dataType.simpleString() for f in added.rows.schema.fields} == {"id": "int", "n": "double", "d": "timestamp_ntz", "t": "string", "m": "decimal(21,2)", "more": "boolean"}
    got = {r["id"]: tuple(map(str, tuple(r)[1:])) for r in added.rows.select("id", "n", "d", "t", "m", "more").collect()}
    assert got == {1: ("1.0", "2026-01-01 00:00:00", "5", "1.50", "None"), 2: ("2.0", "2026-01-02 03:04:05", "x", "7.00", "True"), 3: ("2.5", "None", "6", "2.25", "None")}


def test_wider_types():
    w = lambda a, b: manifest.wider(a, b).simpleString()
    assert w(T.IntegerType(), T.LongType()) == "bigint" and w(T.LongType(), T.FloatType()) == "double" and w(T.DecimalType(10, 2), T.DecimalType(6, 4)) == "decimal(12,4)"
    assert w(T.DateType(), T.TimestampType()) == "timestamp" and w(T.BooleanType(), T.IntegerType()) == "string" and w(T.NullType(), T.DateType()) == "date"


def test_two_loads_of_the_same_files(spark, tmp_path):
    folder, path = f"{tmp_path}/in", f"{tmp_path}/m"
    spark.range(2).write.parquet(f"{folder}/a")
    added = manifest.load_added(spark, folder, path)
    from loadflow.sources import publish

    with publish.claimed(spark, path), pytest.raises(RuntimeError):
        added.done()
    added.done()
    assert manifest.load_added(spark, folder, path).rows is None
