"""The customer-orders mart: cleaned customers, orders with their predecessors, monthly figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadflow.functions.cond import If, IsNull
from loadflow.functions.dates import AddYears, Date, Month, MonthStart, Year
from loadflow.functions.numeric import Num, RangeMax, Sign
from loadflow.functions.string import Capitalize, Left, Len, Trim, Upper
from loadflow.operators.mapping import apply_map, build_map
from loadflow.operators.ordered import peek
from loadflow.operators.tables import natural_join, select
from loadflow.plans.sales import MONEY


def clean_customers(customers: DataFrame, country: DataFrame) -> DataFrame:
    df = apply_map(customers.where(Len(F.col("CustomerID")) > 0), build_map(country, "CountryCode", "CountryName"), "CountryCode", "Country", "N/A")
    signup = Date(F.col("SignupDate"), "YYYY-MM-DD")
    return select(
        df, "CustomerID", CustomerName=Capitalize(F.col("CustomerName")), Email=Upper(Trim(F.col("Email"))), Country=F.col("Country"), AreaCode=Left(F.col("Phone"), 3),
        CreditLimit=If(IsNull(F.col("CreditLimit")), F.lit(0.0), F.col("CreditLimit")), SignupDate=signup, RenewalDate=AddYears(signup, 1), BalanceSign=Sign(F.col("Balance")),
    )


def stage_orders(orders: DataFrame) -> DataFrame:
    """PrevOrderRef is the order before within the customer, by date and id."""
    df = peek(orders, F.col("OrderID"), "PrevOrderRef", ["OrderDate", "OrderID"], ["CustomerID"])
    quantity = Num(F.col("Quantity"), MONEY)
    return select(
        df, "OrderID", "CustomerID", "ProductID", Quantity=quantity, GrossAmount=(Num(F.col("UnitPrice"), MONEY) * quantity).cast(MONEY),
        MaxDiscount=RangeMax(F.col("Discount1"), F.col("Discount2")), PrevOrderRef=F.col("PrevOrderRef"), OrderDate=Date(F.col("OrderDate"), is_text=False), OrderMonth=MonthStart(F.col("OrderDate")),
    )


def orders_mart(orders: DataFrame, customers: DataFrame, country: DataFrame) -> DataFrame:
    """ProductID, Country, OrderYear, OrderMonth; TotalRevenue, OrderCount, AvgOrderValue, MedianOrderValue."""
    df = natural_join(stage_orders(orders), select(clean_customers(customers, country), "CustomerID", "Country", "CreditLimit"), "left")
    gross = F.col("GrossAmount")
    return df.groupBy("ProductID", "Country", Year(F.col("OrderDate")).alias("OrderYear"), Month(F.col("OrderDate")).alias("OrderMonth")).agg(
        F.sum(gross).cast("double").alias("TotalRevenue"), F.count("OrderID").alias("OrderCount"),
        F.round(F.sum(gross).cast("double") / F.count(gross), 4).alias("AvgOrderValue"), F.round(F.median(gross.cast("double")), 4).alias("MedianOrderValue"),
    )
