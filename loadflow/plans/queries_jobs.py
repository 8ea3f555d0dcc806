"""Queries: the three sample pipelines over the given tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadflow.plans import executive, orders_mart, sales
from loadflow.plans.common import QUERIES, query, table

LINES = """
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"""


def _lines(spark: SparkSession, sf: str, which: str = "true") -> DataFrame:
    """Lines with their orders (those of a condition, which reaches the scan) and customers, which meet the orders first, as these are fewer."""
    li, o, c = table(spark, sf, "lineitem"), table(spark, sf, "orders").where(which), table(spark, sf, "customer")
    return li.join(o.join(c, o.o_custkey == c.c_custkey), li.l_orderkey == o.o_orderkey)


def _sales_rows(lines: DataFrame) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    return lines.select(
        text("o_orderkey").alias("OrderID"), F.col("l_partkey").alias("ProductID"), F.col("o_custkey").alias("CustomerID"), F.col("c_nationkey").alias("CountryCode"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("OrderDate"), text("l_quantity").alias("Quantity"), text("l_discount").alias("UnitPrice"), text("l_extendedprice").alias("GrossAmount"),
    )


def _country(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("CountryCode"), F.col("n_name").alias("CountryName"))


@query(f"""
WITH raw AS (
  SELECT l_partkey AS ProductID, CAST(n_name AS VARCHAR) AS Country, o_orderdate AS d, CAST(l_quantity AS DECIMAL(18,4)) AS q,
    CAST(CAST(l_discount AS DECIMAL(18,4)) * CAST(l_quantity AS DECIMAL(18,4)) AS DECIMAL(18,4)) AS g {LINES}
    LEFT JOIN nation ON c_nationkey = n_nationkey WHERE year(o_orderdate) >= 2000
  UNION ALL
  SELECT l_partkey, NULL, o_orderdate, CAST(l_quantity AS DECIMAL(18,4)), CAST(l_extendedprice AS DECIMAL(18,4)) {LINES} WHERE year(o_orderdate) < 2000)
SELECT ProductID, Country, p_type AS TherapeuticArea, CAST(year(d) AS INTEGER) AS OrderYear, CAST(sum(g) AS DOUBLE) AS TotalRevenue, CAST(sum(q) AS DOUBLE) AS TotalUnits
FROM raw LEFT JOIN part ON ProductID = p_partkey GROUP BY ALL""")
def sales_mart(spark: SparkSession, sf: str) -> DataFrame:
    """S1, P2, P4, P5, J2, J10, J11, U1, A0, A1 end to end."""
    products = table(spark, sf, "part").select(
        F.col("p_partkey").alias("ProductID"), F.col("p_name").alias("ProductName"), F.col("p_type").alias("Therapeutic Area"),
        F.col("p_retailprice").cast("string").alias("UnitPrice"), (F.col("p_size") > 25).cast("int").alias("Discontinued"),
    )
    now, before = (_lines(spark, sf, f"o_orderdate {side} timestamp_ntz'2000-01-01'") for side in (">=", "<"))
    return sales.sales_fact(_country(spark, sf), products, _sales_rows(now), _sales_rows(before))


@query("""
WITH o AS (SELECT l_partkey AS ProductID, o_custkey, o_orderdate AS d, CAST(CAST(l_extendedprice AS DECIMAL(18,4)) * CAST(l_quantity AS DECIMAL(18,4)) AS DECIMAL(18,4)) AS g
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
c AS (SELECT c_custkey, coalesce(n_name, 'N/A') AS Country FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)
SELECT ProductID, Country, CAST(year(d) AS INTEGER) AS OrderYear, CAST(month(d) AS INTEGER) AS OrderMonth, CAST(sum(g) AS DOUBLE) AS TotalRevenue, count(*) AS OrderCount,
  round(CAST(sum(g) AS DOUBLE) / count(g), 4) AS AvgOrderValue, round(median(CAST(g AS DOUBLE)), 4) AS MedianOrderValue
FROM o LEFT JOIN c ON o_custkey = c_custkey GROUP BY ALL""")
def orders_monthly_mart(spark: SparkSession, sf: str) -> DataFrame:
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    orders = li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("OrderID"), F.col("o_custkey").alias("CustomerID"), F.col("l_partkey").alias("ProductID"), F.col("l_quantity").alias("Quantity"),
        F.col("l_extendedprice").alias("UnitPrice"), F.col("l_discount").alias("Discount1"), F.col("l_tax").alias("Discount2"), F.to_date("o_orderdate").alias("OrderDate"),
    )
    customers = _customers(spark, sf)
    return orders_mart.orders_mart(orders, customers, _country(spark, sf))


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("CustomerID"), F.lower("c_name").alias("CustomerName"), F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" ")).alias("Email"), F.col("c_nationkey").alias("CountryCode"),
        F.substring("c_name", 10, 9).alias("Phone"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("CreditLimit"), F.lit("2024-02-29").alias("SignupDate"), F.col("c_acctbal").alias("Balance"),
    )


@query("""
SELECT c_custkey AS CustomerID, upper(substr(c_name, 1, 1)) || lower(substr(c_name, 2)) AS CustomerName, upper(trim(c_mktsegment)) AS Email, coalesce(n_name, 'N/A') AS Country,
  left(substr(c_name, 10, 9), 3) AS AreaCode, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END AS CreditLimit, DATE '2024-02-29' AS SignupDate, DATE '2025-02-28' AS RenewalDate, CAST(sign(c_acctbal) AS INTEGER) AS BalanceSign
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def customers_clean(spark: SparkSession, sf: str) -> DataFrame:
    """F1, F3, F12, F16, F18, F26, F43, F59, F79, J11."""
    return orders_mart.clean_customers(_customers(spark, sf), _country(spark, sf))


@query(f"""
WITH s AS (SELECT r_name AS Region, o_custkey, date_trunc('month', l_shipdate)::DATE AS m, CAST(l_extendedprice AS DECIMAL(18,4)) AS a {LINES} JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
e AS (SELECT r_name AS Region, make_date(2000, 1 + CAST(s_suppkey % 12 AS INTEGER), 1) AS m, CAST(s_acctbal AS DECIMAL(18,4)) AS a, CAST(s_suppkey AS DECIMAL(18,4)) AS b
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
f AS (SELECT Region || '_' || strftime(m + INTERVAL 12 MONTH, '%Y%m') AS k, (m + INTERVAL 12 MONTH)::DATE AS y, a, o_custkey AS c FROM s
  UNION ALL SELECT Region || '_' || strftime(m + INTERVAL 12 MONTH, '%Y%m'), (m + INTERVAL 12 MONTH)::DATE, NULL, NULL FROM e),
fa AS (SELECT k, y, CAST(sum(a) AS DOUBLE) AS SalesAmount, count(DISTINCT c) AS n_customers FROM f GROUP BY ALL),
ba AS (SELECT r_name || '_' || strftime(date_trunc('month', o_orderdate) + INTERVAL 12 MONTH, '%Y%m') AS k, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS Budget
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
ea AS (SELECT Region || '_' || strftime(m + INTERVAL 12 MONTH, '%Y%m') AS k, CAST(sum(a) AS DOUBLE) AS ExpenseActual, CAST(sum(b) AS DOUBLE) AS ExpenseBudget FROM e GROUP BY ALL)
SELECT k AS MonthlyRegionKey, y AS YYYYMM, SalesAmount, n_customers, Budget, ExpenseActual, ExpenseBudget, CASE WHEN y <= DATE '2001-06-01' THEN 1 ELSE 0 END AS HistoryFlag
FROM fa LEFT JOIN ba USING (k) LEFT JOIN ea USING (k)""")
def executive_dashboard(spark: SparkSession, sf: str) -> DataFrame:
    """J12, P4, P7, P10, U1, U4, F59, F71, F78 over the star."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", F.col("r_name").alias("Region"))
    lines = _lines(spark, sf).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    facts = lines.select("Region", F.col("o_custkey").alias("CustKey"), F.trunc("l_shipdate", "month").alias("YYYYMM"), F.col("l_extendedprice").alias("Sales Amount"))
    o, c, s = table(spark, sf, "orders"), table(spark, sf, "customer"), table(spark, sf, "supplier")
    budget = o.join(c, o.o_custkey == c.c_custkey).join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("Region", F.trunc("o_orderdate", "month").alias("Month"), F.col("o_totalprice").alias("Budget"))
    month = F.make_date(F.lit(2000), (F.col("s_suppkey") % 12 + 1).cast("int"), F.lit(1))
    expenses = s.join(places, s.s_nationkey == places.n_nationkey).select("Region", month.alias("YYYYMM"), F.col("s_acctbal").alias("ExpenseActual"), F.col("s_suppkey").alias("ExpeenseBudget"))
    return executive.executive_star(facts, budget, expenses, date(2001, 6, 15))


@query(f"""
WITH f AS (SELECT date_trunc('month', l_shipdate) + INTERVAL 12 MONTH AS m, o_custkey, l_partkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(18,4)) AS a {LINES}),
b AS (SELECT c_custkey % 100 AS k, sum(CAST(c_acctbal AS DECIMAL(18,4))) AS o, count(DISTINCT c_mktsegment) AS g FROM customer GROUP BY 1),
i AS (SELECT p_size % 7 + 1 AS l, sum(CAST(p_retailprice AS DECIMAL(18,4))) AS s FROM part WHERE p_partkey % 2 = 0 OR p_size % 7 > 0 GROUP BY 1)
SELECT year(m)::INTEGER AS "Fiscal Year", left(c_mktsegment, 4) AS "SegmentGroup", lower(p_brand) AS "Product Group Desc", n_name AS "Sales Rep Name", count(*) AS n_rows, CAST(sum(a) AS DOUBLE) AS "SalesAmount",
  count(DISTINCT o_custkey % 100) AS n_accounts, CAST(max(o) AS DOUBLE) AS "AROpen", CAST(min(o) AS DOUBLE) AS "ARAgeBal", max(g) AS "ARAges", CAST(max(s) AS DOUBLE) AS "StockOH", min('type ' || p_type) AS first_type
FROM f JOIN customer ON o_custkey = c_custkey LEFT JOIN b ON k = o_custkey % 100 LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN i ON l = l_linenumber LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 20 GROUP BY ALL""")
def executive_star(spark: SparkSession, sf: str) -> DataFrame:
    """Facts with calendar, receivables, customer, channel, sales rep, address, item, product names and inventory."""
    c, p, o, nation = table(spark, sf, "customer"), table(spark, sf, "part"), table(spark, sf, "orders"), table(spark, sf, "nation")
    month = F.add_months(F.trunc("l_shipdate", "month"), 12)
    fact = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("Order"), month.alias("YYYYMM"), F.col("l_partkey").alias("Item-Branch Key"), F.col("l_linenumber").alias("Line Desc 1"), F.col("l_extendedprice").alias("Sales Amount")
    )
    orders = o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("Order"), F.col("o_custkey").alias("CustKey"), F.col("o_custkey").alias("Address Number"))
    calendar = table(spark, sf, "lineitem").select(month.alias("YYYYMM")).distinct().withColumn("Fiscal Year", F.year("YYYYMM"))
    ar_key = (F.col("c_custkey") % 100).alias("CustKeyAR")
    ages = c.select(ar_key, F.col("c_mktsegment").alias("ARAge"), F.col("c_acctbal").alias("ARAgeBal"))
    ar = c.groupBy(ar_key).agg(F.sum(F.col("c_acctbal").cast("decimal(18,4)")).cast("double").alias("AROpen"))
    customers = executive.customer_branch(c.select(F.col("c_custkey").alias("CustKey"), ar_key), ar, ages)
    segments = c.select(F.col("c_mktsegment").alias("Segment")).distinct().withColumn("SegmentGroup", F.substring("Segment", 1, 4))
    reps = nation.where("n_nationkey < 20").select(F.col("n_nationkey").alias("Sales Rep"), F.col("n_name").alias("Sales Rep Name"))
    master = c.select(F.col("c_custkey").alias("Address Number"), F.col("c_mktsegment").alias("Segment"), F.col("c_nationkey").alias("Sales Rep"))
    addresses = executive.address_branch(master, segments, reps, c.select(F.col("c_custkey").alias("Address Number"), F.col("c_name").alias("Customer Address 1")))
    short = F.concat(F.lit("item "), F.col("p_partkey").cast("string")).alias("Short Name")
    named = lambda key, label, text: p.select(F.col(key).alias(label)).distinct().withColumn(f"{label} Desc", text)
    items = executive.item_branch(
        p.select(F.col("p_partkey").alias("Item-Branch Key"), short), p.select(short, F.col("p_brand").alias("Product Group"), F.col("p_size").alias("Product Sub Group"), F.col("p_type").alias("Product Type")),
        named("p_brand", "Product Group", F.lower("Product Group")), named("p_size", "Product Sub Group", F.col("Product Sub Group").cast("string")), named("p_type", "Product Type", F.concat(F.lit("type "), F.col("Product Type"))),
    )
    balances = p.where("p_partkey % 2 = 0 or p_size % 7 > 0").select((F.col("p_size") % 7 + 1).alias("Line Desc 1"), F.col("p_size").alias("ThroughputQty"), F.col("p_retailprice").alias("StockOH"))
    star = executive.whole_star(fact, calendar, customers, addresses, items, executive.inventory_branch(balances), orders)
    # Types are a group of the first sums and texts are compared after it: the least of texts would have every fact sorted.
    groups = ["Fiscal Year", "SegmentGroup", "Product Group Desc", "Sales Rep Name"]
    sums = star.groupBy(*groups, "CustKeyAR", "Product Type Desc").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("Sales Amount").cast("decimal(18,4)")).alias("a"), F.max("AROpen").alias("AROpen"), F.min("ARAgeBal").alias("ARAgeBal"), F.max("ARAges").alias("ARAges"), F.max("StockOH").alias("StockOH")
    )
    return sums.groupBy(*groups).agg(
        F.sum("n").alias("n_rows"), F.sum("a").cast("double").alias("SalesAmount"), F.count_distinct("CustKeyAR").alias("n_accounts"), F.max("AROpen").alias("AROpen"),
        F.min("ARAgeBal").alias("ARAgeBal"), F.max("ARAges").alias("ARAges"), F.max("StockOH").alias("StockOH"), F.min("Product Type Desc").alias("first_type"),
    )


@query("""
SELECT r_name || '_' || strftime(make_date(2000, 1 + CAST(s_suppkey % 12 AS INTEGER), 1) + INTERVAL 12 MONTH, '%Y%m') AS "MonthlyRegionKey", CASE WHEN s_suppkey % 10 < 9 THEN 'group ' || s_suppkey % 3 END AS "AccountGroupDesc",
  CAST(sum(CAST(s_acctbal AS DECIMAL(18,4))) AS DOUBLE) AS "ExpenseActual", CAST(sum(s_suppkey) AS DOUBLE) AS "ExpenseBudget", count(DISTINCT s_name) AS "Accounts"
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def executive_expenses(spark: SparkSession, sf: str) -> DataFrame:
    """Expenses by the groups of their accounts."""
    s, nation, region = table(spark, sf, "supplier"), table(spark, sf, "nation"), table(spark, sf, "region")
    placed = s.join(nation, s.s_nationkey == nation.n_nationkey).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    month = F.make_date(F.lit(2000), (F.col("s_suppkey") % 12 + 1).cast("int"), F.lit(1))
    expenses = placed.select(executive.monthly_region_key(F.col("r_name"), month).alias("MonthlyRegionKey"), F.col("s_suppkey").alias("Account"), F.col("s_acctbal").alias("ExpenseActual"), F.col("s_suppkey").alias("ExpenseBudget"))
    account = F.col("s_suppkey").alias("Account")
    groups = s.select((F.col("s_suppkey") % 3).alias("AccountGroup")).distinct().withColumn("AccountGroupDesc", F.concat(F.lit("group "), F.col("AccountGroup").cast("string")))
    return executive.expense_branch(expenses, s.select(account, F.col("s_name").alias("AccountDesc")), s.where("s_suppkey % 10 < 9").select(account, (F.col("s_suppkey") % 3).alias("AccountGroup")), groups)


__all__ = ["QUERIES"]
