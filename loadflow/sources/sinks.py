"""Layers, and ways to write a table."""

from __future__ import annotations

import uuid
from fnmatch import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadflow.sources.publish import Folder, new_version, prune, replace_folder

# Names of tables that are marts.
MART_PATTERNS = ("*_fact", "*_dim", "fact_*", "dim_*", "fact*", "dim*", "*fact", "*_report", "*_kpi", "*summary")
#: Kinds of row source that make a table staging.
STAGING_KINDS = ("qvd", "file", "sql", "inline")


def layer_of(name: str, kind: str, patterns: tuple[str, ...] = MART_PATTERNS) -> str:
    """Mart by name, staging by row source, else intermediate."""
    if any(fnmatch(name.lower(), p) for p in patterns):
        return "mart"
    return "staging" if kind in STAGING_KINDS else "intermediate"


def layer(name: Column, kind: Column, patterns: tuple[str, ...] = MART_PATTERNS) -> Column:
    """As a column over an inventory of tables."""
    expr = "|".join(p.replace("*", ".*") for p in patterns)
    return F.when(F.lower(name).rlike(f"^({expr})$"), "mart").when(kind.isin(*STAGING_KINDS), "staging").otherwise("intermediate")


def materialise(df: DataFrame, name: str, table_layer: str) -> None:
    """Marts as tables, staging and intermediate layers as views."""
    if table_layer == "mart":
        rebuild(df, name)
    else:
        df.createOrReplaceTempView(name)


def store(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """A table as Parquet files, in place of what is there, which df may read. See publish for readers that must never miss it."""
    replace_folder(df, path, partition_by)


def _versions(spark: SparkSession, name: str) -> Folder:
    """Where the versions of a rebuilt table are."""
    return Folder(spark, f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name.lower()}__versions")


def _quoted(name: str) -> str:
    return ".".join(f"`{part}`" for part in name.split("."))


def _location(spark: SparkSession, name: str) -> str | None:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {_quoted(name)}").where("col_name = 'Location'").collect()
    return rows[0]["data_type"] if rows else None


def rebuild(df: DataFrame, name: str, keep: int = 2) -> None:
    """A table of the catalog, created or replaced; df may read the table itself.

    Rows are written as a version of their own, and the catalog is then told where they are: in one step where columns stay as they are, else
    the old table has another name until the new one is there. Failed and killed jobs leave the old rows. The last
    `keep` versions stay, for queries that began before.
    """
    spark = df.sparkSession
    folder, quoted = _versions(spark, name), _quoted(name)
    version = new_version(folder)
    where = f"{folder.path}/{version}"
    try:
        df.write.parquet(where)
    except BaseException:
        folder.delete(version)
        raise
    schema = spark.read.parquet(where).schema
    there = spark.catalog.tableExists(name)
    if there and spark.table(name).schema == schema and (_location(spark, name) or "").rpartition("/")[0].endswith(folder.name):
        spark.sql(f"ALTER TABLE {quoted} SET LOCATION '{where}'")
    else:
        before = f"{name}__{uuid.uuid4().hex}"
        if there:
            spark.sql(f"ALTER TABLE {quoted} RENAME TO {_quoted(before)}")
        spark.catalog.createTable(name, path=where, source="parquet", schema=schema)
        if there:
            spark.sql(f"DROP TABLE {_quoted(before)}")
    spark.catalog.refreshTable(name)
    prune(folder, version, keep)


def save(df: DataFrame, name: str, overwrite: bool = True) -> None:
    """Into a table of the catalog, in place of its rows, or added to them. A rerun of a job that overwrites changes nothing."""
    if overwrite or not df.sparkSession.catalog.tableExists(name):
        rebuild(df, name)
    else:
        df.write.mode("append").saveAsTable(name)


def drop_table(spark: SparkSession, name: str) -> None:
    """A table of the catalog with its versions; none of that name is no error."""
    spark.sql(f"DROP TABLE IF EXISTS {_quoted(name)}")
    _versions(spark, name).delete()
