"""From raw documents to token ids: quality, near-duplicates, secrets, source mix, encoding. Part of loadflow.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. Its rows are written as
Parquet and read again for the next one. All stages but the last return the columns of documents. run() deletes the
tables that a stage's operator wrote on the way as soon as the stage's rows are written, so that scratch space stays that of one stage;
who calls a stage alone keeps them as long as its result is read. They hold copies of the texts, and are compressed harder than other tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadflow.llm import bpe, mixing, quality_qda, secret_scan, simhash
from loadflow.llm.common import written
from loadflow.llm.queries import table, tokenizer_path
from loadflow.sources.shared import recorded, release

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
CODEC = "spark.sql.parquet.compression.codec"


@contextmanager
def dense(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside are compressed by zstd."""
    before = spark.conf.get(CODEC)
    spark.conf.set(CODEC, "zstd")
    try:
        yield
    finally:
        spark.conf.set(CODEC, before)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    with dense(spark):
        judged = quality_qda.classify(docs, table(spark, sf_dir, "labels"), keep=docs.columns)
    return judged.where(F.col("predicted") == 1).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    with dense(spark):
        return simhash.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; live credentials are replaced by a mark."""
    with dense(spark):
        return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them, a row for each round over a source; see mixing.mix_documents."""
    with dense(spark):
        return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text for each row."""
    return bpe.encode_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("near-dedup", near_dedup),
    ("secret scan", secrets),
    ("source mix", mix),
    ("bpe", encode),
]

#: SQL can't express the fingerprints, the classifier or the encoder; tests hold run() against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        with recorded() as paths:
            try:
                docs = written(stage(spark, docs, sf_dir))
            except BaseException:
                release(spark, paths + before)
                raise
        release(spark, paths[:-1] + before)  # the last is that of the stage's rows
        before = paths[-1:]
    return docs
