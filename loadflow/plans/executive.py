"""The executive star: facts by region and month, with budgets and expenses that share the same key."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadflow.functions.cond import If
from loadflow.functions.dates import AddMonths, Date, MonthStart
from loadflow.operators.tables import concatenate, drop_fields, join_all, load_distinct, rename, select


def monthly_region_key(region: Column, month: Column) -> Column:
    """Region & '_' & the month a year later as YYYYMM."""
    return F.concat(region, F.lit("_"), Date(AddMonths(month, 12), "YYYYMM", is_text=False))


def fact_table(sales: DataFrame, expenses: DataFrame) -> DataFrame:
    """sales(Region, CustKey, YYYYMM, Sales Amount) with keys and shifted months, and the keys of expenses appended; Region goes."""
    own = select(sales, "Region", "CustKey", "Sales Amount", MonthlyRegionKey=monthly_region_key(F.col("Region"), F.col("YYYYMM")), YYYYMM=AddMonths(F.col("YYYYMM"), 12))
    keys = select(expenses, "Region", MonthlyRegionKey=monthly_region_key(F.col("Region"), F.col("YYYYMM")), YYYYMM=AddMonths(F.col("YYYYMM"), 12))
    return drop_fields(concatenate(own, keys), "Region")


def is_history(month: Column, as_of: date) -> Column:
    """1 for months up to the month of as_of, else 0."""
    return If(month <= MonthStart(F.lit(as_of)), F.lit(1), F.lit(0))


def history_flag(fact: DataFrame, as_of: date) -> DataFrame:
    """The table of months with their flags."""
    return load_distinct(fact, "YYYYMM").withColumn("HistoryFlag", is_history(F.col("YYYYMM"), as_of))


def executive_star(sales: DataFrame, budget: DataFrame, expenses: DataFrame, as_of: date) -> DataFrame:
    """Per MonthlyRegionKey: SalesAmount, n_customers, Budget, ExpenseActual, ExpenseBudget, HistoryFlag.

    Budget and expenses meet the facts many to many on the key, so that each side is summed to the key before the join.
    """
    expenses = rename(expenses, {"ExpeenseBudget": "ExpenseBudget"})
    fact = fact_table(sales, expenses)
    money = lambda c: F.sum(F.col(f"`{c}`").cast("decimal(18,4)")).cast("double")
    facts = fact.groupBy("MonthlyRegionKey", "YYYYMM").agg(money("Sales Amount").alias("SalesAmount"), F.count_distinct("CustKey").alias("n_customers"))
    budgets = budget.groupBy(monthly_region_key(F.col("Region"), F.col("Month")).alias("MonthlyRegionKey")).agg(money("Budget").alias("Budget"))
    spent = expenses.groupBy(monthly_region_key(F.col("Region"), F.col("YYYYMM")).alias("MonthlyRegionKey")).agg(money("ExpenseActual").alias("ExpenseActual"), money("ExpenseBudget").alias("ExpenseBudget"))
    return join_all(facts, [(budgets, "left"), (spent, "left")]).withColumn("HistoryFlag", is_history(F.col("YYYYMM"), as_of))


def customer_branch(customer_map: DataFrame, ar: DataFrame, ar_ages: DataFrame) -> DataFrame:
    """CustKey with its receivables: those of CustKeyAR, whose ages (several rows each) are summed to the key first."""
    ages = ar_ages.groupBy("CustKeyAR").agg(F.sum(F.col("ARAgeBal").cast("decimal(18,4)")).cast("double").alias("ARAgeBal"), F.count_distinct("ARAge").alias("ARAges"))
    return join_all(customer_map, [(ar, "left"), (ages, "left")])


def address_branch(customers: DataFrame, channels: DataFrame, reps: DataFrame, addresses: DataFrame) -> DataFrame:
    """Customers by `Address Number` with channel, sales rep and address."""
    return join_all(customers, [(channels, "left"), (reps, "left"), (addresses, "left")])


def item_branch(branches: DataFrame, items: DataFrame, groups: DataFrame, subgroups: DataFrame, types: DataFrame) -> DataFrame:
    """`Item-Branch Key` with the item and the names of its product group, sub group and type."""
    return join_all(branches, [(items, "left"), (groups, "left"), (subgroups, "left"), (types, "left")])


def inventory_branch(balances: DataFrame) -> DataFrame:
    """`Line Desc 1` with its balances, summed: a line has several."""
    money = lambda c: F.sum(F.col(c).cast("decimal(18,4)")).cast("double").alias(c)
    return balances.groupBy("Line Desc 1").agg(money("ThroughputQty"), money("StockOH"))


def expense_branch(expenses: DataFrame, accounts: DataFrame, account_master: DataFrame, account_groups: DataFrame) -> DataFrame:
    """MonthlyRegionKey and AccountGroupDesc: what was spent and budgeted, and how many accounts have a name."""
    money = lambda c: F.sum(F.col(c).cast("decimal(18,4)")).cast("double").alias(c)
    named = join_all(expenses, [(accounts, "left"), (account_master, "left"), (account_groups, "left")])
    return named.groupBy("MonthlyRegionKey", "AccountGroupDesc").agg(money("ExpenseActual"), money("ExpenseBudget"), F.count_distinct("AccountDesc").alias("Accounts"))


def whole_star(fact: DataFrame, calendar: DataFrame, customers: DataFrame, addresses: DataFrame, items: DataFrame, inventory: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Every fact row with all that its keys lead to. Each branch has one row a key, so that facts aren't multiplied.

    heads: what facts share, such as orders, with the keys of customers and addresses; facts without a head go. Customers and addresses then meet
    the heads, which are fewer than the facts, and facts are shuffled for their items and their heads only, with the few columns of their items.
    """
    if heads is None:
        return join_all(fact, [(calendar, "left"), (customers, "left"), (addresses, "left"), (items, "left"), (inventory, "left")])
    known = join_all(heads, [(customers, "left"), (addresses, "left")])
    return join_all(fact, [(items, "left"), (calendar, "left"), (inventory, "left"), (known, "inner")])
