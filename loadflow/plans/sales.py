"""The sales pipeline: two years of sales, products and a country map into one fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadflow.functions.cond import If
from loadflow.functions.dates import Date, Year
from loadflow.functions.numeric import Num
from loadflow.functions.string import Left, Len
from loadflow.operators.mapping import apply_map, build_map
from loadflow.operators.tables import concatenate, natural_join, select

#: Money keeps its cents exactly while it is summed, in whatever order.
MONEY = "decimal(18,4)"


def stage_products(products: DataFrame) -> DataFrame:
    return select(products, "ProductID", "ProductName", TherapeuticArea=F.col("`Therapeutic Area`"), UnitPrice=Num(F.col("UnitPrice")), IsDiscontinued=If(F.col("Discontinued") == 1, F.lit("Y"), F.lit("N")))


def stage_sales(sales: DataFrame, country_ref: DataFrame) -> DataFrame:
    kept = sales.where(Len(F.col("OrderID")) > 0)
    mapped = apply_map(kept, build_map(country_ref, "CountryCode", "CountryName"), "CountryCode", "Country", "Unknown")
    return select(
        mapped, "OrderID", "ProductID", "CustomerID", "CountryCode", OrderDate=Date(F.col("OrderDate"), "YYYY-MM-DD"), Quantity=Num(F.col("Quantity"), MONEY),
        GrossAmount=(Num(F.col("UnitPrice"), MONEY) * Num(F.col("Quantity"), MONEY)).cast(MONEY), Country=F.col("Country"), OrderPrefix=Left(F.col("OrderID"), 4),
    )


def stage_prior(sales: DataFrame) -> DataFrame:
    return select(sales, "OrderID", "ProductID", "CustomerID", "CountryCode", OrderDate=Date(F.col("OrderDate"), "YYYY-MM-DD"), Quantity=Num(F.col("Quantity"), MONEY), GrossAmount=Num(F.col("GrossAmount"), MONEY))


def sales_fact(country_ref: DataFrame, products: DataFrame, sales: DataFrame, prior: DataFrame) -> DataFrame:
    """ProductID, Country, TherapeuticArea, OrderYear, TotalRevenue, TotalUnits. Prior-year rows have no country, as their load has none.

    Rows are dealt by the mart's keys and summed before the product join, so that no task sorts rows for the join beside its sums; what meets the
    products, by a shuffle where they don't fit a broadcast, is the sums. A product that is listed n times counts n times.
    """
    raw = concatenate(stage_sales(sales, country_ref), stage_prior(prior))
    keys = ["ProductID", "Country", "OrderYear"]
    dealt = select(raw, "ProductID", "Country", "Quantity", "GrossAmount", OrderYear=Year(F.col("OrderDate"))).repartition(*keys)
    sums = dealt.groupBy(*keys).agg(F.sum("GrossAmount").alias("_revenue"), F.sum("Quantity").alias("_units"))
    listed = stage_products(products).groupBy("ProductID", "TherapeuticArea").agg(F.count(F.lit(1)).alias("_n"))
    times = lambda c: (F.col(c) * F.coalesce("_n", F.lit(1))).cast("double")
    return select(natural_join(sums, listed, "left"), "ProductID", "Country", "TherapeuticArea", "OrderYear", TotalRevenue=times("_revenue"), TotalUnits=times("_units"))
