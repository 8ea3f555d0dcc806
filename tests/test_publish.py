"""Publishing: old rows stay until all new ones are there."""

import os
import signal
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from loadflow.sources import publish, readers, sinks

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ids(df):
    return sorted(r[0] for r in df.collect())


def hidden(tmp_path):
    return [f for f in os.listdir(tmp_path) if f.startswith(".") and not f.endswith(".crc")]


def test_store_over_what_is_read(spark, tmp_path):
    path = f"{tmp_path}/history"
    sinks.store(spark.range(5), path)
    old = readers.load_parquet(spark, path)
    sinks.store(old.unionByName(spark.range(5, 7)), path)
    assert ids(readers.load_parquet(spark, path)) == [0, 1, 2, 3, 4, 5, 6] == ids(spark.read.parquet(path))
    sinks.store(readers.load_parquet(spark, path).withColumn("p", F.col("id") % 2), path, ["p"])
    assert ids(readers.load_parquet(spark, path).where("p = 1").select("id")) == [1, 3, 5] and hidden(tmp_path) == []


def test_failed_store_leaves_the_old_rows(spark, tmp_path):
    path = f"{tmp_path}/t"
    sinks.store(spark.range(3), path)
    bad = readers.load_parquet(spark, path).select(F.when(F.col("id") < 2, F.col("id")).otherwise(F.raise_error(F.lit("bad row")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="bad row"):
        sinks.store(bad, path)
    with pytest.raises(Exception, match="bad row"):
        publish.publish(bad, f"{tmp_path}/p")
    assert ids(readers.load_parquet(spark, path)) == [0, 1, 2] and hidden(tmp_path) == [] and publish.current(spark, f"{tmp_path}/p") is None
    sinks.rebuild(spark.range(3), "publish_bad")
    with pytest.raises(Exception, match="bad row"):
        sinks.rebuild(bad, "publish_bad")
    assert ids(spark.table("publish_bad")) == [0, 1, 2]
    sinks.drop_table(spark, "publish_bad")


KILLED = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
from loadflow.sources import readers, sinks
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", {path!r} + "_w").getOrCreate()
slow = F.udf(lambda i: __import__("time").sleep(3) or i, "long")
df = readers.load_parquet(spark, {path!r})
sinks.store(df.unionByName(spark.range(100, 400)).repartition(40).select(slow("id").alias("id")), {path!r})
"""


def test_killed_store_leaves_the_old_rows(spark, tmp_path):
    path = f"{tmp_path}/history"
    sinks.store(spark.range(5), path)
    job = subprocess.Popen([sys.executable, "-c", KILLED.format(root=ROOT, path=path)], stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, start_new_session=True)
    until = time.time() + 120
    while not hidden(tmp_path) and job.poll() is None and time.time() < until:
        time.sleep(0.2)
    time.sleep(4)  # some tasks have written
    assert job.poll() is None and hidden(tmp_path)
    os.killpg(job.pid, signal.SIGKILL)
    job.wait()
    assert ids(spark.read.parquet(path)) == [0, 1, 2, 3, 4]
    sinks.store(spark.range(2), path)
    assert ids(readers.load_parquet(spark, path)) == [0, 1]
    left = hidden(tmp_path)
    assert len(left) == 1  # of the killed job, until it is a day old
    os.utime(tmp_path / left[0], (0, 0))
    publish.recover(spark, path)
    assert hidden(tmp_path) == []


def test_kill_between_renames_is_put_right(spark, tmp_path):
    path = f"{tmp_path}/t"
    sinks.store(spark.range(3), path)
    os.rename(path, f"{tmp_path}/.t.old-1")
    assert ids(readers.load_parquet(spark, path)) == [0, 1, 2]  # no complete new rows: the old ones come back
    spark.range(9).write.parquet(f"{tmp_path}/.t.new-2")
    os.rename(path, f"{tmp_path}/.t.old-2")
    assert len(ids(readers.load_parquet(spark, path))) == 9 and hidden(tmp_path) == []


def test_pointer_and_versions(spark, tmp_path):
    path = f"{tmp_path}/p"
    publish.publish(spark.range(3), path)
    old = publish.published(spark, path)
    publish.publish(old.unionByName(spark.range(3, 5)), path)
    assert ids(publish.published(spark, path)) == [0, 1, 2, 3, 4] and ids(old) == [0, 1, 2]  # who began before ends with the old rows
    spark.range(7).write.parquet(f"{path}/v000000009-half")  # another job's, without a pointer
    assert ids(publish.published(spark, path)) == [0, 1, 2, 3, 4]
    publish.publish(spark.range(1), path)
    assert ids(publish.published(spark, path)) == [0] and len([f for f in os.listdir(path) if f.startswith("v")]) == 2
    with pytest.raises(FileNotFoundError):
        publish.published(spark, f"{tmp_path}/none")


def test_tables_of_the_catalog(spark):
    name = "publish_t"
    sinks.drop_table(spark, name)
    spark.range(3).write.saveAsTable(name)  # one that was made otherwise
    sinks.rebuild(spark.table(name).where("id > 0"), name)
    sinks.rebuild(spark.table(name).unionByName(spark.range(10, 12)), name)
    assert ids(spark.table(name)) == [1, 2, 10, 11]
    before = spark.table(name)
    sinks.rebuild(spark.table(name).select((F.col("id") + 1).alias("id"), F.lit("x").alias("other")), name)
    assert spark.table(name).columns == ["id", "other"] and ids(spark.table(name)) == [2, 3, 11, 12] and ids(before) == [1, 2, 10, 11]
    sinks.save(spark.table(name), name, overwrite=False)
    assert spark.table(name).count() == 8
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith(name)] == [name]
    sinks.drop_table(spark, name)
    assert not spark.catalog.tableExists(name)
