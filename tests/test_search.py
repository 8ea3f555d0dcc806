"""Search by a written index and reconciliation by digests."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loadflow.operators import inventory, search
from loadflow.sources.shared import recorded


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


TEXTS = [
    (1, "The licence; the LICENSE. other_name"), (2, None), (3, ""), (4, "bathe the theatre"), (5, "aaaa aaa aa_a"), (6, "größe Größer GRÖSSE"), (7, "x y z 1 22 333"), (8, "license" * 5), (9, "the\nthe\tthe_the"),
]


@pytest.mark.parametrize("question", ["the license", "The, the! THE", "aa", "aaa aa", "größe", "nowhere_at_all", "", "1 2 y", "theatre other_name"])
def test_search_equals_a_scan(spark, tmp_path, question):
    df = spark.createDataFrame([(*t, "x") for t in TEXTS], "id int, text string, word string")
    search.build_index(df, "text", "id", f"{tmp_path}/i", buckets=3)
    for k in (1, 4, 20):
        want = [tuple(r) for r in inventory.retrieve(df.select("id", "text"), "text", question, k, "id").select("id", "score").collect()]
        assert [tuple(r) for r in search.search(spark, f"{tmp_path}/i", question, k).collect()] == want


def test_only_buckets_of_the_terms_are_read(spark, sf_dir, tmp_path):
    path = f"{tmp_path}/i"
    search.build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", "doc_id", path, buckets=32)
    found = search.search(spark, path, "license warranty", 5)
    text = plan(found)
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ IN", text) or "PartitionFilters: [isnotnull(bucket" in text
    assert "PushedFilters: [In(word" in text or "PushedFilters: [IsNotNull(word), In(word" in text or "EqualTo(word" in text
    scanned = {r["bucket"] for r in search._of_index(spark, path, "postings").where(F.col("bucket").isin([r["bucket"] for r in search.matching_words(spark, path, "license warranty").collect()])).select("bucket").distinct().collect()}
    assert 0 < len(scanned) < 32
    assert search.search(spark, path, "license warranty", 5).collect() == found.collect()


def test_index_and_search_shuffle_no_words_of_texts(spark, tmp_path):
    """The build writes no table on the way; a question that over 1000 words answer joins none; a key's rows are added up, in whatever tasks they are."""
    texts = [(i % 40, " ".join(f"w{j}the{j % 7}" for j in range(i % 50 * 30, i % 50 * 30 + 60)) + " The other") for i in range(120)] + [(None, "the the"), (None, "the"), (41, "THE " * 500), (42, "none")]
    df = spark.createDataFrame(texts, "id int, text string").repartition(7)
    path = f"{tmp_path}/i"
    with recorded() as paths:
        search.build_index(df, "text", "id", path, buckets=3)
    assert paths == []
    assert search.matching_words(spark, path, "the").count() > 1000
    found = search.search(spark, path, "the", 50)
    assert "Join" not in plan(found)
    want = {}
    for key, text in texts:
        want[key] = want.get(key, 0) + text.lower().count("the")
    ordered = sorted(((k, n) for k, n in want.items() if n), key=lambda x: (-x[1], x[0] is not None, x[0] or 0))
    assert [tuple(r) for r in found.collect()] == ordered[:50]
    postings = search._of_index(spark, path, "postings")
    assert postings.count() == postings.select("word", "key").distinct().count()
    rows = {r["word"]: r["n"] for r in postings.groupBy("word").agg(F.count("*").alias("n")).collect()}
    words = search._of_index(spark, path, "words").collect()
    assert {r["word"]: r["n_rows"] for r in words} == rows and len(words) == len(rows)
    assert postings.select("word", "bucket").distinct().join(search._of_index(spark, path, "words"), ["word", "bucket"]).count() == len(rows)


def test_reconcile_names_one_changed_row(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    row = li.orderBy("l_orderkey", "l_linenumber").first()
    hit = (F.col("l_orderkey") == row["l_orderkey"]) & (F.col("l_linenumber") == row["l_linenumber"])
    other = li.withColumn("l_comment_", F.lit(1)).drop("l_comment_").withColumn("l_tax", F.when(hit, F.col("l_tax") + 0.01).otherwise(F.col("l_tax")))
    keys = ["l_orderkey", "l_linenumber"]
    assert [tuple(r) for r in search.reconcile_rows(li, other.repartition(7), keys).collect()] == [(row["l_orderkey"], row["l_linenumber"], "changed")]
    assert search.differing_buckets(li, other, keys, 256).count() == 1  # rows of all others are not compared
    assert search.reconcile_rows(li, li.repartition(3), keys).count() == 0


def test_reconcile_against_dictionaries(spark):
    rnd = random.Random(8)
    for _ in range(4):
        make = lambda: [(rnd.choice([None, *range(12)]), rnd.choice([None, "a", "b"])) for _ in range(rnd.randint(0, 25))]
        a, b = make(), make()
        x, y = spark.createDataFrame(a, "k int, v string"), spark.createDataFrame([(v, k) for k, v in b], "v string, k int")
        of = lambda rows: {k: sorted((v for j, v in rows if j == k), key=str) for k, _ in rows}
        s, t = of(a), of(b)
        want = {(k, "missing" if k not in t else "extra" if k not in s else "changed") for k in {*s, *t} if s.get(k) != t.get(k)}
        assert {tuple(r) for r in search.reconcile_rows(x, y, ["k"], buckets=5).collect()} == want
        assert {r["kind"]: r["n"] for r in search.reconcile_counts(x, y, ["k"], 3).collect()} == {kind: sum(w[1] == kind for w in want) for kind in {w[1] for w in want}}
