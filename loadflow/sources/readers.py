"""Row sources."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadflow.sources.publish import recover


def load_parquet(spark: SparkSession, path: str, *fields: str) -> DataFrame:
    """A columnar extract; only the fields named are read. One whose store was killed between its renames is put right first."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException:
        recover(spark, path)
        df = spark.read.parquet(path)
    return df.select(*[F.col(f"`{f}`") for f in fields]) if fields else df


def load_text(spark: SparkSession, path: str, schema: T.StructType | str, delimiter: str = ",", encoding: str = "UTF-8", labels: bool = True) -> DataFrame:
    """Delimited text; labels: the first line of each file names the columns. The schema is given, so that nothing is read twice."""
    return spark.read.schema(schema).option("header", labels).option("sep", delimiter).option("encoding", encoding).csv(path)


def load_sql(spark: SparkSession, query: str) -> DataFrame:
    """S3: a SELECT over views and tables of the session."""
    return spark.sql(query)


def load_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """S3: a table or query of a database, read in `parts` ranges of a number column."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if column:
        reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()


def load_resident(spark: SparkSession, name: str, *fields: str) -> DataFrame:
    """A table that is already built, by its name."""
    df = spark.table(f"`{name}`")
    return df.select(*[F.col(f"`{f}`") for f in fields]) if fields else df


def load_inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small literal table, which a join broadcasts: Spark can't tell its size, and would deal the other table to a task for each of a few keys.

    A full join, and one that keeps all rows of the literal table, can't broadcast it.
    """
    return F.broadcast(spark.createDataFrame(rows, schema))


def autogenerate(spark: SparkSession, n: int, out: str = "recno") -> DataFrame:
    """Numbers 1 to n."""
    return spark.range(1, n + 1).withColumnRenamed("id", out)


def load_each(spark: SparkSession, paths: list[str], file_col: str | None = None) -> DataFrame:
    """Files of one layout as one scan, not a union of scans; file_col names the file of each row."""
    df = spark.read.parquet(*paths)
    return df.withColumn(file_col, F.col("_metadata.file_path")) if file_col else df


def load_named(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A file under a table name, for jobs that load many alike."""
    df = load_parquet(spark, path)
    df.createOrReplaceTempView(name)
    return df
