"""What Spark makes of the queries: no Python in plans, no pairs of all rows, pruned and filtered scans, partial sums first."""

import re

import pytest
from pyspark.sql import functions as F

from loadflow.operators import ordered, tables
from loadflow.plans import catalog, executive, sales
from loadflow.sources import readers

CROSS = {"j9_cross", "s11_layers"}  # all pairs are the feature, or a literal of four rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_no_python_and_no_all_pairs(spark, sf_dir, name):
    text = plan(catalog.queries()[name](spark, sf_dir))
    assert not re.search("Python|Pandas|ArrowEval", text)
    if name not in CROSS:
        assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", text)


def test_scan_reads_only_what_is_asked(spark, sf_dir):
    df = readers.load_parquet(spark, f"{sf_dir}/lineitem.parquet", "l_orderkey", "l_quantity").where("l_quantity > 40")
    text = plan(df)
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text and "GreaterThan(l_quantity,40.0)" in text


def test_mart_sums_before_it_shuffles(spark, sf_dir):
    text = plan(catalog.queries()["sales_mart"](spark, sf_dir))
    assert "partial_sum" in text


def test_global_numbers_use_no_single_partition_of_rows(spark, sf_dir):
    df = ordered.row_numbers(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), "n", ["o_orderkey"])
    single = [x for x in plan(df).splitlines() if "SinglePartition" in x]
    assert len(single) == 1  # of one count a range
    assert "partial_count" in plan(df)


def test_many_files_are_one_scan(spark, tmp_path):
    paths = [f"{tmp_path}/{i}" for i in range(4)]
    for p in paths:
        spark.range(3).write.parquet(p)
    assert plan(readers.load_each(spark, paths)).count("FileScan parquet") == 1


def test_distinct_projects_first(spark, sf_dir):
    text = plan(tables.load_distinct(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderstatus"))
    assert "ReadSchema: struct<o_orderstatus:string>" in text


def test_top_k_needs_no_global_sort(spark, sf_dir):
    text = plan(ordered.top_k(spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("o_totalprice"), 3, ["o_orderkey"]))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def above(text, *marks):
    """The operators above the scan that has these marks, from it to the root."""
    lines = text.split("== Initial Plan ==")[0].splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :|+-"))
    i = next(i for i, x in enumerate(lines) if "FileScan" in x and all(m in x for m in marks))
    found, least = [], depth(lines[i])
    for x in reversed(lines[:i]):
        if depth(x) < least:
            found, least = [*found, x], depth(x)
    return found


def test_star_takes_no_facts_to_customers_and_sorts_none_for_sums(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ops = above(plan(catalog.queries()["executive_star"](spark, sf_dir)), "l_orderkey", "l_extendedprice")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [x for x in ops if "Exchange hashpartitioning" in x]
    assert dealt and not any("custkey" in x or "CustKey#" in x or "Address Number" in x for x in dealt)
    assert "HashAggregate" in next(x for x in ops if "Aggregate" in x)


def test_star_with_heads_is_the_star_of_joined_facts(spark):
    make = spark.createDataFrame
    heads = make([(1, 10, 10), (2, 11, 11), (3, None, None), (4, 12, 12)], "Order int, CustKey int, `Address Number` int")
    lines = make([(1, "a", 1, 5.0), (1, "b", None, None), (2, None, 1, 7.0), (3, "a", 2, 1.0), (9, "a", 1, 2.0), (None, "a", 1, 2.0)], "Order int, `Item-Branch Key` string, m int, Amount double")
    parts = [make([(1, 2001)], "m int, y int"), make([(10, 0), (12, 2)], "CustKey int, CustKeyAR int"), make([(11, "s")], "`Address Number` int, Segment string"), make([("a", "A")], "`Item-Branch Key` string, item string"), make([(2, 3.0)], "m int, stock double")]
    joined = executive.whole_star(lines.join(heads, "Order"), *parts)
    out = executive.whole_star(lines, *parts, heads).select(joined.columns)
    assert sorted(map(str, out.collect())) == sorted(map(str, joined.collect())) and out.count() == 4


def test_rows_stay_where_they_are_read_when_they_meet_a_literal_table(spark, sf_dir):
    ops = above(plan(catalog.queries()["s5_load_inline"](spark, sf_dir)), "o_orderstatus")
    join = next(i for i, x in enumerate(ops) if "Join" in x)
    assert "BroadcastHashJoin" in ops[join] and not any("Exchange" in x or "Sort" in x for x in ops[:join])


def test_mart_sums_before_it_meets_products(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ops = above(plan(catalog.queries()["sales_mart"](spark, sf_dir)), "l_orderkey", "l_extendedprice")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert next(i for i, x in enumerate(ops) if "Aggregate" in x) < next(i for i, x in enumerate(ops) if "SortMergeJoin [ProductID#" in x)


def test_products_listed_twice_count_twice(spark):
    make = spark.createDataFrame
    products = make([(1, "a", "x", "1", 0), (1, "b", "x", "1", 0), (1, "c", "y", "1", 0), (2, "d", None, "1", 1)], "ProductID int, ProductName string, `Therapeutic Area` string, UnitPrice string, Discontinued int")
    shape = "OrderID string, ProductID int, CustomerID int, CountryCode int, OrderDate string, Quantity string, UnitPrice string, GrossAmount string"
    now = make([("1", 1, 1, 7, "2001-02-03", "2", "1.5", "9"), ("2", 3, 1, 8, "2001-02-03", "1", "1", "9"), ("", 1, 1, 7, "2001-02-03", "2", "1.5", "9")], shape)
    before = make([("3", 1, 1, 7, "1999-02-03", "1", "1", "4.25"), ("4", 2, 1, 7, "1999-02-03", None, "1", "x"), ("5", None, 1, 7, "1999-02-03", "1", "1", "1")], shape)
    out = sales.sales_fact(make([(7, "P")], "CountryCode int, CountryName string"), products, now, before)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([
        (1, "P", "x", 2001, 6.0, 4.0), (1, "P", "y", 2001, 3.0, 2.0), (3, "Unknown", None, 2001, 1.0, 1.0), (1, None, "x", 1999, 8.5, 2.0), (1, None, "y", 1999, 4.25, 1.0), (2, None, None, 1999, None, None),
        (None, None, None, 1999, 1.0, 1.0),
    ], key=str)
