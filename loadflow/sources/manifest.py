"""A manifest of loaded files: a rerun of a load reads only what has come since, and files whose columns drift are widened."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadflow.operators.tables import quoted
from loadflow.sources.publish import claimed, current, publish, published
from loadflow.sources.shared import written

_WHOLE = {"byte": 1, "short": 2, "int": 4, "integer": 4, "long": 8, "bigint": 8, "tinyint": 1, "smallint": 2}


def wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """A type that holds the values of both: the longer whole number, decimal before double where both sides have exact digits, timestamp
    before date, and text for all that has nothing else in common."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    names = [x.simpleString() for x in (a, b)]
    if all(n in _WHOLE for n in names):
        return max((a, b), key=lambda x: _WHOLE[x.simpleString()])
    if all(n in _WHOLE or isinstance(x, T.DecimalType) for n, x in zip(names, (a, b), strict=True)):
        digits = [(x.precision, x.scale) if isinstance(x, T.DecimalType) else (19, 0) for x in (a, b)]
        scale = max(s for _, s in digits)
        return T.DecimalType(min(38, scale + max(p - s for p, s in digits)), scale)
    if all(isinstance(x, T.NumericType) for x in (a, b)):
        return T.DoubleType()
    if all(isinstance(x, (T.DateType, T.TimestampNTZType, T.TimestampType)) for x in (a, b)):
        return T.TimestampType() if any(isinstance(x, T.TimestampType) for x in (a, b)) else T.TimestampNTZType()
    return T.StringType()


def widened(schemas: list[T.StructType]) -> T.StructType:
    """All columns of some schemas without regard to case, in the order in which they appear, each in a type that holds all of its values."""
    found: dict[str, T.StructField] = {}
    for schema in schemas:
        for f in schema.fields:
            old = found.get(f.name.lower())
            found[f.name.lower()] = T.StructField(f.name if old is None else old.name, f.dataType if old is None else wider(old.dataType, f.dataType))
    return T.StructType(list(found.values()))


def read_drifting(spark: SparkSession, files: list[str], file_col: str | None = None) -> DataFrame:
    """Files of one table whose columns may differ: those that a file lacks are null, types are widened.

    Spark merges the schemas of files that only lack columns, in one distributed pass over their footers. Where types differ too, files are grouped by
    schema, and each group is one scan; then footers are read one after another.
    """
    named = lambda df: df.withColumn(file_col, F.col("_metadata.file_path")) if file_col else df
    try:
        return named(spark.read.option("mergeSchema", True).parquet(*files))
    except (PySparkException, Py4JJavaError) as e:
        if "CANNOT_MERGE" not in str(e):
            raise
    groups: dict[str, tuple[T.StructType, list[str]]] = {}
    for f in files:
        schema = spark.read.parquet(f).schema
        groups.setdefault(schema.json(), (schema, []))[1].append(f)
    target = widened([s for s, _ in groups.values()])
    parts = []
    for schema, own in groups.values():
        df, names = named(spark.read.schema(schema).parquet(*own)), {c.lower(): c for c in schema.names}
        columns = [(quoted(names[f.name.lower()]) if f.name.lower() in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.fields]
        parts.append(df.select(*columns, *([quoted(file_col)] if file_col else [])))
    return reduce(DataFrame.unionByName, parts)


@dataclass
class Added:
    """Files that have come since the last load, their rows (None without files), and a call that says that these are loaded."""

    spark: SparkSession
    path: str
    files: DataFrame
    rows: DataFrame | None

    def done(self) -> None:
        """Records the files; to be called when what was made of the rows is stored. Of two loads of the same files one call wins, the other raises an error."""
        if self.rows is None:
            return
        with claimed(self.spark, self.path):
            known = [published(self.spark, self.path)] if current(self.spark, self.path) else []
            publish(reduce(DataFrame.unionByName, [*known, self.files]), self.path)


def load_added(spark: SparkSession, folder: str, path: str, file_col: str | None = None) -> Added:
    """The Parquet files below a folder that the manifest at path doesn't have with their size and time.

    Files are listed by Spark, without reading them; a file that was written anew is one that has come. A load that fails before done() is
    called sees the same files again. The names of the files that have come are collected, as a scan needs them.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder)
    files = listed.select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("changed"))
    if current(spark, path):
        files = files.join(published(spark, path), ["file", "size", "changed"], "left_anti")
    files = written(files)
    names = [r["file"] for r in files.select("file").orderBy("file").collect()]
    return Added(spark, path, files, read_drifting(spark, names, file_col) if names else None)
