"""Mergeable sketches, stored dictionaries, lineage events, and edge cases of functions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loadflow.functions import string
from loadflow.operators import inventory, lineage, ordered, sketches
from loadflow.sources import publish
from loadflow.sources.shared import written


def test_merged_days_equal_one_pass_within_the_error(spark, tmp_path):
    rnd = random.Random(4)
    data = [(d, g, rnd.lognormvariate(0, 2) if g else None, rnd.randrange(3000 if g else 5)) for d in range(6) for g in (0, 1, 2) for _ in range(400 * (d + 1))]
    df = spark.createDataFrame(data, "day int, g int, x double, item int")
    for d in range(6):
        sketches.sketched(df.where(F.col("day") == d), ["day", "g"], F.col("x"), F.col("item")).write.mode("append").parquet(f"{tmp_path}/states")
    wanted = {"low": 0.0, "q10": 0.1, "med": 0.5, "q99": 0.99, "high": 1.0}
    got = {r["g"]: r for r in sketches.read_off(sketches.merged(spark.read.parquet(f"{tmp_path}/states"), ["g"]), wanted).collect()}
    for g in (0, 1, 2):
        xs, items = sorted(x for _, h, x, _ in data if h == g and x is not None), len({i for _, h, _, i in data if h == g})
        assert got[g]["n"] == len(xs) and abs(got[g]["n_distinct"] - items) <= max(1, sketches.DISTINCT_ERROR * items)
        if not xs:
            assert all(got[g][w] is None for w in wanted)
            continue
        assert (got[g]["low"], got[g]["high"]) == (xs[0], xs[-1])
        for name, p in wanted.items():
            assert abs(sum(x <= got[g][name] for x in xs) / len(xs) - p) <= sketches.RANK_ERROR or p == 0.0
    assert sketches.sketched(df.where("false"), ["g"], F.col("x"), F.col("item")).count() == 0


def numbers(df):
    return {r["v"]: r["n"] for r in df.collect()}


def test_numbers_stay_from_load_to_load(spark, tmp_path):
    path = f"{tmp_path}/dictionary"
    load = lambda rows: ordered.autonumber_stored(spark.createDataFrame(rows, "v string, o int"), F.col("v"), "n", F.col("o"), path)
    first = numbers(load([("b", 2), ("a", 1), ("b", 0), (None, 5)]))
    assert first == {"b": 1, "a": 2, None: None}
    second = numbers(load([("z", 1), ("a", 0), ("c", 3), ("c", 0), (None, 1)]))
    assert second == {"a": 2, "c": 3, "z": 4, None: None}
    version = publish.current(spark, path)
    assert numbers(load([("b", 9)])) == {"b": 1} and publish.current(spark, path) == version  # nothing new, nothing written
    assert publish.published(spark, path).count() == 4
    assert numbers(load([("b", 1), ("d", 1)])) == {"b": 1, "d": 5}


def test_one_of_two_loads_wins(spark, tmp_path):
    path = f"{tmp_path}/dictionary"
    publish.publish(spark.createDataFrame([("a", 1)], "_value string, _number long"), path)
    df = spark.createDataFrame([("b", 1)], "v string, o int")
    with publish.claimed(spark, path):
        with pytest.raises(RuntimeError, match="another job"):
            ordered.autonumber_stored(df, F.col("v"), "n", F.col("o"), path)
    assert publish.published(spark, path).count() == 1
    assert numbers(ordered.autonumber_stored(df, F.col("v"), "n", F.col("o"), path)) == {"b": 2}


def test_lineage_events(spark):
    deps = spark.createDataFrame([("s", "T", "a", "Raw", "x", True), ("s", "T", "a", "mid", "y", False), ("s", "T", "b", "raw", "z", True), ("s", "U", "c", "db", "k", True)], "script string, tbl string, col string, upstream string, up_col string, external boolean")
    kinds = spark.createDataFrame([("s", "T", "a", "derived"), ("s", "T", "b", "direct"), ("s", "U", "c", "lookup")], "script string, tbl string, col string, kind string")
    sources = spark.createDataFrame([("s", "RAW", "lib://x/raw.qvd", "qvd"), ("s", "db", "table", "sql"), ("z", "mid", "x", "file")], "script string, source string, locator string, kind string")
    rows = lineage.lineage_events(deps, kinds, sources, "lake://m", "me", "r1", "2026-01-01T00:00:00Z").collect()
    events = {r["tbl"]: json.loads(r["event"]) for r in rows}
    t = events["T"]
    assert (t["eventType"], t["eventTime"], t["run"], t["job"]["namespace"], t["job"]["name"]) == ("COMPLETE", "2026-01-01T00:00:00Z", {"runId": "r1"}, "s", "T")
    assert t["job"]["facets"]["jobType"] == {"processingType": "BATCH", "jobType": "TASK"}
    assert t["inputs"] == [{"namespace": "lake://m", "name": "mid"}, {"namespace": "qvd://lib", "name": "Raw"}, {"namespace": "qvd://lib", "name": "raw"}]
    fields = t["outputs"][0]["facets"]["columnLineage"]["fields"]
    assert [f["field"] for f in fields["a"]["inputFields"]] == ["y", "x"] and fields["b"]["inputFields"][0]["transformations"] == [{"type": "DIRECT", "subtype": "direct"}]
    assert events["U"]["inputs"] == [{"namespace": "db://source", "name": "db"}] and len(events) == 2


def test_edges_of_functions(spark):
    df = spark.createDataFrame([("a-b-c",), ("",), (None,)], "s string")
    got = df.select(string.SubField(F.col("s"), "-", 0).alias("z"), string.SubField(F.col("s"), "-", -1).alias("l"), string.FindOneOf(F.col("s"), "").alias("f"), string.FindOneOf(F.col("s"), "cb").alias("g")).collect()
    assert [tuple(r) for r in got] == [(None, "c", 0, 3), (None, "", 0, 0), (None, None, None, None)]


def test_effort_ignores_case(spark):
    columns = spark.createDataFrame([("s", "Fact", "a", 0, False)], "script string, tbl string, col string, n_warnings int, grouped boolean")
    joins = spark.createDataFrame([("s", "FACT"), ("s", "fact")], "script string, base_tbl string")
    assert inventory.effort(columns, joins).collect()[0][:] == ("s", "Fact", 4.2, "Low")
    assert written(columns).count() == 1
