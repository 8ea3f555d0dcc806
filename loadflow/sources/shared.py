"""Tables written in the folder that driver and executors share: the end of a long lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a local master has one of its own; on a cluster, whose machines
    share no such folder, that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp")))
    return context.getCheckpointDir()


_recorders: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of tables that are written inside, for release() once nothing reads them any more."""
    paths: list[str] = []
    _recorders.append(paths)
    try:
        yield paths
    finally:
        _recorders[:] = [p for p in _recorders if p is not paths]


def release(spark: SparkSession, paths: list[str]) -> None:
    """Deletes written tables. DataFrames that still read them fail from then on."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """The folders of a folder, in order of their names."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    return sorted(f.getPath().toString() for f in found if f.isDirectory())


def written(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here, and lost executors cost nothing before it.

    row_id adds a column that tells equal rows apart; it is fixed once the table is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    if row_id:
        df = df.withColumn(row_id, F.monotonically_increasing_id())
    df.write.parquet(path)
    for paths in _recorders:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> Column:
    """A number that deals equal rows out: a hash of the row and of the task that reads it.

    A repeated task gives its rows the same numbers, so that a shuffle by it survives lost executors; rows that are equal in all
    columns stay together only as far as one task has read them.
    """
    own = [F.col("`" + f.name.replace("`", "``") + "`") for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return F.xxhash64(*own, F.spark_partition_id())
