"""Best-sellers of each cluster, less what a customer already has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.joins import join_by_customer
from shelfwise.session import cut_lineage

KEY = "CustomerID"
WORD = 63  # places in a word of a mask
SALTS = 64


def drop_outlier_lines(lines: DataFrame, outliers: DataFrame) -> DataFrame:
    return join_by_customer(lines, outliers.select(KEY), KEY, "left_anti")


def lines_with_cluster(lines: DataFrame, customers: DataFrame) -> DataFrame:
    return join_by_customer(lines, customers.select(KEY, "cluster"), KEY)


def best_sellers(lines: DataFrame, customers: DataFrame) -> DataFrame:
    """Net quantity of each product in each cluster. The lines of heavy
    customers are spread out in the join, and all are summed up on the map side."""
    sold = lines_with_cluster(lines.select(KEY, "StockCode", "Description", "Quantity"), customers)
    return sold.groupBy("cluster", "StockCode", "Description").agg(F.sum("Quantity").alias("Quantity"))


def top_products(sellers: DataFrame, n: int = 10) -> DataFrame:
    """The n best-sellers of each cluster.

    Each task keeps only its own top n before the shuffle by cluster. Spark
    does so for short lists; for a longer one the products of a cluster are
    first dealt out by a hash, and the top n of each share meet."""
    by = [F.col("Quantity").desc(), "StockCode", "Description"]

    def top(df: DataFrame, *group: str) -> DataFrame:
        order = Window.partitionBy(*group).orderBy(*by)
        return df.withColumn("Rank", F.row_number().over(order)).where(F.col("Rank") <= n)

    if n > int(sellers.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        dealt = sellers.withColumn("salt", F.pmod(F.xxhash64("StockCode", "Description"), F.lit(SALTS)))
        sellers = top(dealt, "cluster", "salt").drop("salt", "Rank")
    return top(sellers, "cluster")


def purchases(lines: DataFrame, customers: DataFrame) -> DataFrame:
    """What each customer of a cluster has bought; cancelled lines count."""
    bought = lines.select(KEY, "StockCode").distinct()
    return bought.join(customers.select(KEY, "cluster"), KEY).select(KEY, "cluster", "StockCode")


def top_lists(top: DataFrame) -> DataFrame:
    """One row for each cluster, with its top products as an ordered array."""
    product = F.struct("Rank", "StockCode", "Description")
    return top.groupBy("cluster").agg(F.array_sort(F.collect_list(product)).alias("top"))


def stored_lists(lines: DataFrame, customers: DataFrame, n: int) -> DataFrame:
    """The top lists, stored: they are tiny, cost a pass over all lines, and
    are joined twice."""
    return cut_lineage(top_lists(top_products(best_sellers(lines, customers), n)))


def bought_masks(lines: DataFrame, customers: DataFrame, lists: DataFrame, n: int) -> DataFrame:
    """The places in the top list of their cluster that each customer has
    bought, as bits of `bought`, an array of words.

    Lines are cut down to purchases of top products first, and to one for each
    customer and product; then the masks of the products are or-ed.
    """
    places = lists.select("cluster", F.posexplode("top").alias("place", "product"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place") % WORD)
    words = range((n - 1) // WORD + 1)
    # a code with two descriptions has two places
    masks = places.groupBy("cluster", F.col("product.StockCode").alias("StockCode")).agg(
        *[F.coalesce(F.bit_or(F.when(F.floor(F.col("place") / F.lit(WORD)) == w, bit)), F.lit(0)).alias(f"word_{w}") for w in words]
    )
    top_codes = masks.select("StockCode").distinct()
    bought = lines.select(KEY, "StockCode").join(top_codes, "StockCode", "left_semi").distinct()
    return (
        bought.join(customers.select(KEY, "cluster"), KEY)
        .join(masks, ["cluster", "StockCode"])
        .groupBy(KEY)
        .agg(*[F.bit_or(f"word_{w}").alias(f"word_{w}") for w in words])
        .select(KEY, F.array(*[f"word_{w}" for w in words]).alias("bought"))
    )


def not_bought(lines: DataFrame, customers: DataFrame, lists: DataFrame, n: int) -> DataFrame:
    """Each customer with the top products of the cluster they have not bought."""
    place = lambda i: F.call_function("shiftright", F.get("bought", F.floor(i / F.lit(WORD)).cast("int")), i % WORD)
    is_bought = lambda i: F.coalesce(place(i).bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(False))
    return (
        customers.join(bought_masks(lines, customers, lists, n), KEY, "left")
        .join(lists, "cluster")
        .withColumn("options", F.filter("top", lambda product, i: ~is_bought(i)))
        .drop("bought", "top")
    )


def candidates(lines: DataFrame, customers: DataFrame, top_n: int = 10, k: int = 3) -> DataFrame:
    """The first k products not bought, one row each."""
    lists = stored_lists(lines, customers, top_n)
    return (
        not_bought(lines, customers.select(KEY, "cluster"), lists, top_n)
        .select(KEY, "cluster", F.posexplode(F.slice("options", 1, k)).alias("position", "product"))
        .select(
            KEY,
            "cluster",
            (F.col("position") + 1).alias("Position"),
            F.col("product.StockCode").alias("StockCode"),
            F.col("product.Description").alias("Description"),
        )
    )


def recommend(
    lines: DataFrame,
    customers: DataFrame,
    outliers: DataFrame | None = None,
    top_n: int = 10,
    k: int = 3,
) -> DataFrame:
    """Customers with their columns, cluster and k recommended products, each
    a code and a description; slots without a product are null.

    Lines of customers without a cluster never reach the best-sellers, so
    `outliers` is needed only if `customers` may contain some of them.
    """
    if outliers is not None:
        customers = customers.join(outliers.select(KEY), KEY, "left_anti")
    lists = stored_lists(lines, customers, top_n)
    return wide(not_bought(lines, customers, lists, top_n), k)


def wide(options: DataFrame, k: int = 3) -> DataFrame:
    """The first k options as pairs of columns."""
    slots: list[Column] = []
    for i in range(1, k + 1):
        product = F.try_element_at("options", F.lit(i))
        slots.append(product["StockCode"].alias(f"Rec{i}_StockCode"))
        slots.append(product["Description"].alias(f"Rec{i}_Description"))
    kept = [c for c in options.columns if c not in ("options", "cluster")]
    return options.select(*kept, "cluster", *slots)
