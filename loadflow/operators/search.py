"""Keyword retrieval from a written index, and row-level reconciliation by digests."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadflow.operators.tables import quoted
from loadflow.sources.publish import current, publish
from loadflow.sources.shared import written

#: What a question's terms are, and the runs of characters that texts are indexed by: a term never goes beyond a run. The ranges are part of \w and only quicker.
TERM, RUN = r"[A-Za-z_]\w+", r"(?U)[0-9a-z_\w]+"


def terms(question: str) -> list[str]:
    """Distinct terms in order, in lower case."""
    return list(dict.fromkeys(w.lower() for w in re.findall(TERM, question)))


def build_index(df: DataFrame, text: str, key: str, path: str, buckets: int = 64) -> None:
    """M8: an inverted index of df's texts, published at path.

    words(word, bucket, n_rows): the vocabulary. postings(bucket, word, key, n): how often a word stands in a row's text, a folder for each
    bucket of words, sorted by word inside of each file. keys(key): all rows, for questions that find none. Words are the runs of letters, digits and
    _ of the lower-cased text. One row a key is expected; rows of one key are added up. Null texts have no words.

    Texts are shuffled by their keys, which is less than their words would be; words are then counted, sorted and written where the texts are, so
    that each task leaves a file of its rows in each bucket.
    """
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    rows = df.select(quoted(key).alias("key"), quoted(text).alias("text")).repartition("key")
    counts = rows.select("key", F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("word")).groupBy("word", "key").agg(F.count(F.lit(1)).cast("int").alias("n"))
    bucket = F.pmod(F.xxhash64("word"), F.lit(buckets)).cast("int").alias("bucket")
    publish(counts.select(bucket, "word", "key", "n").sortWithinPartitions("bucket", "word"), f"{path}/postings", ["bucket"])
    vocabulary = _of_index(df.sparkSession, path, "postings").groupBy("word").agg(F.count(F.lit(1)).alias("n_rows"))
    publish(vocabulary.select("word", bucket, "n_rows"), f"{path}/words")
    publish(df.select(quoted(key).alias("key")).distinct(), f"{path}/keys")


def _of_index(spark: SparkSession, path: str, table: str) -> DataFrame:
    version = current(spark, f"{path}/{table}")
    if version is None:
        raise FileNotFoundError(f"no index at {path}")
    return spark.read.parquet(version)


def _times(question: str) -> Column:
    """How often a word holds terms (places of one term don't overlap)."""
    times = F.lit(0)
    for t in terms(question):
        times = times + ((F.length("word") - F.length(F.replace(F.col("word"), F.lit(t), F.lit("")))) / len(t)).cast("int")
    return times


def matching_words(spark: SparkSession, path: str, question: str) -> DataFrame:
    """word, bucket, times: the words of the vocabulary that hold a term, and how often they hold terms."""
    return _of_index(spark, path, "words").withColumn("times", _times(question)).where("times > 0")


def search(spark: SparkSession, path: str, question: str, k: int) -> DataFrame:
    """M8: key and score as `retrieve` gives them, read from the index: the k rows with the greatest score above 0, ties by key; if there is none, the first k keys with 0.

    A term may stand inside of words, so the vocabulary is searched first, which is small beside the texts; then only the buckets and words that
    hold terms are read from the postings. How often a word holds terms is told from the word again, so that postings meet no other table.
    """
    found = written(matching_words(spark, path, question))
    near = [r["bucket"] for r in found.select("bucket").distinct().collect()]  # at most the number of buckets
    if near:
        few = found.limit(1001).select("word").collect()
        hits = _of_index(spark, path, "postings").where(F.col("bucket").isin(near))
        if len(few) <= 1000:  # as literals they also pass over row groups by their least and greatest words
            hits = hits.where(F.col("word").isin([r["word"] for r in few]))
        else:
            hits = hits.where(reduce(Column.__or__, [F.col("word").contains(t) for t in terms(question)]))
        scored = hits.groupBy("key").agg(F.sum(F.col("n") * _times(question)).cast("int").alias("score"))
        return scored.orderBy(F.desc("score"), "key").limit(k)
    return _of_index(spark, path, "keys").orderBy("key").limit(k).withColumn("score", F.lit(0))


def row_digests(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """bucket, key, d1, d2: a digest of each row by the bucket of its key; nulls differ from everything else."""
    own = [x for c in df.columns for x in (quoted(c), quoted(c).isNull())]
    bucket = F.pmod(F.xxhash64(*[x for k in keys for x in (quoted(k), quoted(k).isNull())]), F.lit(buckets))
    return df.select(bucket.alias("bucket"), F.struct(*[quoted(k).alias(k) for k in keys]).alias("key"), F.xxhash64(*own).alias("d1"), F.xxhash64(F.lit(1), *own).alias("d2"))


def bucket_digests(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """bucket, n, x1, x2, s: a digest of all rows of each bucket that doesn't depend on their order: counts, exclusive ors and a sum, so
    that repeated rows count. Partial aggregates: what is shuffled is a row for each task and bucket."""
    d = row_digests(df, keys, buckets)
    return d.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("d1").alias("x1"), F.bit_xor("d2").alias("x2"), F.sum(F.shiftright("d1", 16)).alias("s"))


def differing_buckets(source: DataFrame, target: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    a, b = (bucket_digests(df, keys, buckets).withColumn("side", F.lit(side)) for df, side in ((source, 1), (target, 2)))
    same = F.struct("n", "x1", "x2", "s")
    both = a.unionByName(b).groupBy("bucket").agg(F.min(same).alias("low"), F.max(same).alias("high"), F.count_distinct("side").alias("sides"))
    return both.where((F.col("low") != F.col("high")) | (F.col("sides") < 2)).select("bucket")


def reconcile_rows(source: DataFrame, target: DataFrame, keys: list[str], buckets: int = 4096) -> DataFrame:
    """M9: the keys of both tables' rows that differ, and `kind`: missing (in target), extra (not in source), or changed.

    Order-free digests of buckets of keys are compared first, one row a bucket; only rows of buckets that differ are then
    compared, by 128-bit digests, so that what is equal is read but never shuffled. Both tables have the same columns, in any order, with types that
    compare; null keys are keys. Rows that repeat on one side only make their key `changed`.
    """
    names = source.columns
    target = target.select(*[quoted(c) for c in names])
    odd = written(differing_buckets(source, target, keys, buckets))  # at most `buckets` rows
    sides = []
    for name, df in (("_s", source), ("_t", target)):
        rows = row_digests(df, keys, buckets).join(F.broadcast(odd), "bucket", "left_semi")
        one = rows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("d1", "d2"))).alias(name))
        sides.append(one)
    s, t = sides
    both = s.join(t, s["key"].eqNullSafe(t["key"]), "full")
    kind = F.when(F.col("_t").isNull(), "missing").when(F.col("_s").isNull(), "extra").when(F.col("_s") != F.col("_t"), "changed")
    return both.select(F.coalesce(s["key"], t["key"]).alias("key"), kind.alias("kind")).where("kind is not null").select("key.*", "kind")


def reconcile_counts(source: DataFrame, target: DataFrame, keys: list[str], buckets: int = 4096) -> DataFrame:
    """M9: kind and n of reconcile_rows; no row of a kind that doesn't occur."""
    return reconcile_rows(source, target, keys, buckets).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
