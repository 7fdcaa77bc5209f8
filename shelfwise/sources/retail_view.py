"""Invoice lines derived from the order tables of the test data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.config import Settings

VIEW_SETTINGS = Settings(home_country="NATION_0", service_names=("small ring", "red widget"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def retail_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each line item. Returned items are cancelled lines; some
    customers, descriptions, countries and prices are missing or zero, and the
    lines of every 25th customer occur twice."""
    returned = F.col("l_returnflag") == "R"
    order = F.col("o_orderkey")
    customer = (
        F.when(order % 40 == 0, F.lit(None))
        .when(order % 500 == 3, order + 1_000_000)
        .otherwise(F.col("o_custkey"))
        .cast("long")
    )
    # what a line takes from its order, so that the join carries nothing else of it
    orders = table(spark, folder, "orders").select(
        "o_orderkey", (F.col("o_orderdate") + _hours(order % 24)).alias("InvoiceDate"), customer.alias("CustomerID")
    )
    # orders come last: the lines of an invoice are then side by side, which packs them well in tables, and the join
    # carries what the ones before it have made of the keys they are done with
    priced = (
        table(spark, folder, "lineitem")
        .join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            "l_orderkey",
            returned.alias("returned"),
            F.col("l_partkey").cast("string").alias("StockCode"),
            F.when(F.col("l_partkey") % 50 != 0, F.col("p_name")).alias("Description"),
            F.when(returned, -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast("int").alias("Quantity"),
            F.when(F.col("l_partkey") % 70 == 0, 0)
            .otherwise(F.col("p_retailprice"))
            .cast("decimal(12,2)")
            .alias("UnitPrice"),
            F.when(F.col("l_suppkey") % 20 != 0, F.col("n_name")).alias("Country"),
        )
    )
    lines = priced.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.when(F.col("returned"), "C").otherwise(""), F.col("l_orderkey").cast("string")).alias("InvoiceNo"),
        "StockCode",
        "Description",
        "Quantity",
        "InvoiceDate",
        "UnitPrice",
        "CustomerID",
        "Country",
    )
    copies = F.when(F.col("CustomerID") % 25 == 0, 2).otherwise(1)
    return lines.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).drop("copy")


def market_segments(spark: SparkSession, folder: str) -> DataFrame:
    """A fixed assignment of customers to clusters."""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("CustomerID"), F.col("c_mktsegment").alias("cluster")
    )


def _hours(hours: Column) -> Column:
    return F.make_dt_interval(hours=hours.cast("int"))
