"""One named query for each operator, over the retail view of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.config import Settings
from shelfwise.functions import columns as X
from shelfwise.operators import cleaning, clusters, features, outliers, recommend, reduction, scaling
from shelfwise.plans import segmentation
from shelfwise.session import cut_lineage, dropping_stored, new_path, store
from shelfwise.sources import transactions as io
from shelfwise.sources.retail_view import VIEW_SETTINGS, market_segments, retail_lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters that the oracles repeat.
MARKERS = ("NATION_3", "green bolt")
CENTROIDS = [[10.0, 20.0, 200000.0], [100.0, 10.0, 100000.0], [400.0, 5.0, 50000.0]]
CENTROID_COLUMNS = ["Days_Since_Last_Purchase", "Total_Transactions", "Total_Spend"]
FIXED_LABELS = {0: 1, 1: 2, 2: 0}


def query(name: str) -> Callable[[Query], Query]:
    def register(make: Query) -> Query:
        QUERIES[name] = make
        return make

    return register


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles and decimals as rounded doubles, dates and times as text."""

    def one(field: T.StructField) -> Column:
        if isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            return F.round(F.col(field.name).cast("double"), digits).alias(field.name)
        if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.col(field.name).cast("string").alias(field.name)
        return F.col(field.name)

    return df.select(*[one(field) for field in df.schema])


def cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.clean(retail_lines(spark, folder), VIEW_SETTINGS)


def stored_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaned lines for what reads them several times: joined and rid of copies
    once, and stored with the lines of a customer together."""
    return store(features.customers_together(cleaned(spark, folder)), "lines")


def customer_table(spark: SparkSession, folder: str, settings: Settings = VIEW_SETTINGS) -> DataFrame:
    """Features of lines that are joined once; copies are dropped where features
    bring the lines of a customer together."""
    lines = store(cleaning.sound_lines(retail_lines(spark, folder), settings), "lines")
    return features.features_with_copies(lines, settings)


def shop(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Cleaned lines, and features with the market segment as the cluster,
    both stored because the recommender reads them more than once. Lines are
    joined once, then dealt by customer once: that drops copies, and as they are
    stored so, neither features nor the recommender shuffle them by customer."""
    with dropping_stored(spark) as keep:
        copies = store(cleaning.sound_lines(retail_lines(spark, folder), VIEW_SETTINGS), "copies")
        span = features.line_span(copies)
        light, heavy, tasks = features.deal(copies)
        light = keep(store(cleaning.without_copies(light), "lines", (tasks, features.KEY)))
        if heavy is not None:
            heavy = keep(store(cleaning.without_copies(heavy), "lines"))
    customers = features.dealt_features(light, heavy, VIEW_SETTINGS, span)
    lines = light if heavy is None else light.unionByName(heavy)
    return lines, cut_lineage(customers.join(market_segments(spark, folder), features.KEY))


def stored_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Features for the models, which read them several times."""
    return cut_lineage(customer_table(spark, folder))


def with_score(customers: DataFrame) -> DataFrame:
    """Features with the spend as a given score."""
    return customers.withColumn("score", F.col("Total_Spend"))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return with_score(stored_customers(spark, folder))


def by_remainder(spark: SparkSession, folder: str) -> DataFrame:
    """Features with a fixed numbered cluster, of sizes that differ."""
    remainder = F.least(F.col("CustomerID") % 7, F.lit(2)).cast("int")
    return stored_customers(spark, folder).withColumn("cluster", F.lit(2) - remainder)


def raw_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Uncleaned lines; the customer is a double, as in a file with gaps."""
    return retail_lines(spark, folder).withColumn("CustomerID", F.col("CustomerID").cast("double"))


def numbers(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c in features.FEATURES]


# ---------------------------------------------------------------- sources and sinks


@query("s1_csv_scan")
def _(spark, folder):
    path = new_path(spark, "lines")
    text = raw_lines(spark, folder).withColumn("InvoiceDate", F.date_format("InvoiceDate", io.DATE_PATTERN))
    text.write.option("header", True).option("encoding", "ISO-8859-1").option("escape", '"').csv(path)
    return plain(io.read_transactions(spark, path))


@query("s2_normalize_nulls")
def _(spark, folder):
    return plain(io.normalize_nulls(raw_lines(spark, folder), MARKERS))


@query("s3_csv_sink")
def _(spark, folder):
    path = new_path(spark, "recommendations")
    result = recommend.recommend(*shop(spark, folder))
    io.write_recommendations(result, path)
    schema = T.StructType(
        [
            T.StructField(f.name, T.DoubleType() if f.name == "CustomerID" else f.dataType)
            for f in result.schema
        ]
    )
    return plain(spark.read.schema(schema).option("header", True).option("escape", '"').csv(path))


@query("s4_preview")
def _(spark, folder):
    return plain(io.preview(recommend.recommend(*shop(spark, folder))))


@query("s5_sample_rows")
def _(spark, folder):
    return io.sample_rows(recommend.recommend(*shop(spark, folder)))


# ---------------------------------------------------------------- cleaning


@query("c1_drop_missing")
def _(spark, folder):
    return plain(cleaning.drop_missing(raw_lines(spark, folder)))


@query("c2_dedupe")
def _(spark, folder):
    return plain(cleaning.dedupe(cleaning.drop_missing(raw_lines(spark, folder))))


@query("c3_status")
def _(spark, folder):
    return plain(cleaning.with_status(raw_lines(spark, folder)))


@query("c4_anomalous_codes")
def _(spark, folder):
    return cleaning.anomalous_stock_codes(raw_lines(spark, folder))


@query("c5_drop_anomalous")
def _(spark, folder):
    return plain(cleaning.drop_anomalous(raw_lines(spark, folder)))


@query("c6_drop_service")
def _(spark, folder):
    lines = cleaning.drop_missing(raw_lines(spark, folder))
    return plain(cleaning.drop_service_lines(lines, VIEW_SETTINGS.service_names))


@query("c7_upper")
def _(spark, folder):
    return plain(cleaning.upper_description(raw_lines(spark, folder)))


@query("c8_positive_price")
def _(spark, folder):
    return plain(cleaning.positive_price(raw_lines(spark, folder)))


@query("c9_service_pct")
def _(spark, folder):
    lines = cleaning.dedupe(cleaning.drop_missing(raw_lines(spark, folder)))
    return plain(cleaning.service_line_pct(cleaning.drop_anomalous(lines), VIEW_SETTINGS.service_names))


@query("c10_clean")
def _(spark, folder):
    return plain(cleaned(spark, folder))


@query("t5_stock_codes")
def _(spark, folder):
    return cleaning.stock_codes(cleaning.drop_missing(raw_lines(spark, folder)))


# ---------------------------------------------------------------- scalar functions


@query("f1_parse_timestamp")
def _(spark, folder):
    text = F.date_format("InvoiceDate", io.DATE_PATTERN)
    lines = raw_lines(spark, folder).select("InvoiceNo", "StockCode", text.alias("text"))
    parsed = X.parse_timestamp("text", io.DATE_PATTERN)
    return plain(lines.select("InvoiceNo", "StockCode", parsed.alias("InvoiceDate")))


@query("f_line_columns")
def _(spark, folder):
    lines = features.with_line_columns(cleaned(spark, folder))
    return plain(
        lines.select(
            "InvoiceNo",
            "StockCode",
            F.col("CustomerID").cast("double").alias("CustomerID"),
            "InvoiceDay",
            "Total_Spend",
            "Day_Of_Week",
            "Hour",
            "Year",
            "Month",
            F.datediff(F.lit("1999-01-01").cast("date"), F.col("InvoiceDay")).alias("Days_Before_1999"),
            X.digit_count("StockCode").alias("Digits"),
            X.flag(F.col("Country") == VIEW_SETTINGS.home_country).alias("Is_Home"),
            X.flag(X.is_cancelled()).alias("Is_Cancelled"),
        ).withColumn("Is_Home", X.zero_if_null("Is_Home"))
    )


# ---------------------------------------------------------------- features

for _name, _feature in {
    "a1_last_day": features.last_day,
    "a2_recency": features.recency,
    "a3_transactions": features.transactions,
    "a4_quantity": features.quantity,
    "a5_spend": features.spend,
    "a6_avg_transaction": features.average_transaction,
    "a7_unique_products": features.unique_products,
    "a8_favorite_day": features.favorite_day,
    "a9_favorite_hour": features.favorite_hour,
    "a10_cancellations": features.cancellations,
    "a11_cancellation_rate": features.cancellation_rate,
    "a12_main_country": features.main_country,
    "a13_monthly_spend": features.monthly_spend,
    "a14_monthly_stats": features.monthly_stats,
    "a15_trend": features.spending_trend,
    "w1_gap_closed_form": features.gap_closed_form,
    "w1_gap_window": features.gap_by_window,
    "w2_month_ordinal": features.month_ordinals,
    "j2_multi_line_customers": features.multi_line_customers,
    "j8_global_last_day": features.global_last_day,
}.items():
    QUERIES[_name] = lambda spark, folder, feature=_feature: plain(feature(cleaned(spark, folder)))


def without_countries(lines: DataFrame) -> DataFrame:
    """Every 40th customer has no country on any line, so that nulls count."""
    return lines.withColumn("Country", F.when(F.col("CustomerID") % 40 != 0, F.col("Country")))


@query("a12_home_country")
def _(spark, folder):
    return features.home_country(without_countries(cleaned(spark, folder)), VIEW_SETTINGS.home_country)


@query("j3_left_join_home")
def _(spark, folder):
    home = features.home_country(cleaned(spark, folder), VIEW_SETTINGS.home_country)
    return home.withColumn("Is_UK", X.zero_if_null("Is_UK"))


@query("a17_features")
def _(spark, folder):
    return plain(customer_table(spark, folder))


@query("a17_features_with_rate")
def _(spark, folder):
    from dataclasses import replace

    return plain(customer_table(spark, folder, replace(VIEW_SETTINGS, with_rate=True)))


# ---------------------------------------------------------------- joins


@query("j4_drop_outlier_lines")
def _(spark, folder):
    lines = stored_lines(spark, folder)
    customers = cut_lineage(features.customer_features(lines, VIEW_SETTINGS))
    spend = with_score(customers).select("CustomerID", "score")
    marked = outliers.flag_outliers(spend, outliers.contamination_threshold(spend))
    _, outside = outliers.split_outliers(marked)
    # stored, so that its size is known before the lines would be shuffled for the join
    return plain(recommend.drop_outlier_lines(lines, cut_lineage(outside.select("CustomerID"))))


@query("j5_lines_with_cluster")
def _(spark, folder):
    return plain(recommend.lines_with_cluster(stored_lines(spark, folder), market_segments(spark, folder)))


@query("m9_append_cluster")
def _(spark, folder):
    table = customer_table(spark, folder)
    return plain(clusters.append_cluster(table, market_segments(spark, folder)))


# ---------------------------------------------------------------- models


@query("m1_isolation_forest")
def _(spark, folder):
    return plain(segmentation.find_outliers(stored_customers(spark, folder), VIEW_SETTINGS))


@query("m2_split")
def _(spark, folder):
    table = scored(spark, folder).select("CustomerID", "Total_Spend", "score")
    marked = outliers.flag_outliers(table, outliers.contamination_threshold(table))
    inside, outside = outliers.split_outliers(marked)
    return plain(
        inside.withColumn("Part", F.lit("inlier")).unionByName(
            outside.drop("Outlier_Scores", "Is_Outlier").withColumn("Part", F.lit("outlier"))
        )
    )


@query("m2_flags")
def _(spark, folder):
    table = scored(spark, folder).select("CustomerID", "score")
    return outliers.flag_outliers(table, outliers.contamination_threshold(table))


@query("m3_threshold")
def _(spark, folder):
    table = scored(spark, folder).select("score")
    threshold = outliers.contamination_threshold(table)
    above = table.agg(
        F.lit(threshold).alias("threshold"),
        F.count_if(F.col("score") > threshold).alias("outliers"),
        F.count(F.lit(1)).alias("customers"),
    )
    return plain(above)


@query("m5_scale")
def _(spark, folder):
    return plain(scaling.standardize(stored_customers(spark, folder)))


@query("m6_pca")
def _(spark, folder):
    scaled = cut_lineage(scaling.standardize(stored_customers(spark, folder)))
    return plain(reduction.fit_components(scaled, numbers(scaled)).transform(scaled), 4)


@query("m6b_covariance")
def _(spark, folder):
    table = stored_customers(spark, folder)
    return plain(reduction.covariance(scaling.standardize(table), numbers(table)))


@query("m6c_explained_variance")
def _(spark, folder):
    scaled = cut_lineage(scaling.standardize(stored_customers(spark, folder)))
    shares = reduction.explained_variance(scaled, numbers(scaled))
    rows = [(i, float(share)) for i, share in enumerate(shares, start=1)]
    return plain(spark.createDataFrame(rows, "component int, share double"))


@query("m7_kmeans")
def _(spark, folder):
    scaled = cut_lineage(scaling.standardize(stored_customers(spark, folder)))
    reduced = reduction.fit_components(scaled, numbers(scaled)).transform(scaled)
    axes = [c for c in reduced.columns if c != "CustomerID"]
    centroids, _ = clusters.fit_centroids(reduced, axes)
    return plain(clusters.relabel(clusters.assign(reduced, axes, centroids)))


@query("m7b_assign")
def _(spark, folder):
    table = stored_customers(spark, folder).select("CustomerID", *CENTROID_COLUMNS)
    return clusters.assign(table, CENTROID_COLUMNS, CENTROIDS).select("CustomerID", "cluster")


@query("m8_relabel")
def _(spark, folder):
    table = by_remainder(spark, folder).select("CustomerID", "cluster")
    return clusters.relabel(table)


@query("m8_relabel_fixed")
def _(spark, folder):
    table = by_remainder(spark, folder).select("CustomerID", "cluster")
    return clusters.relabel(table, FIXED_LABELS)


@query("a18_cluster_sizes")
def _(spark, folder):
    return clusters.cluster_sizes(by_remainder(spark, folder))


@query("m10_quality")
def _(spark, folder):
    table = by_remainder(spark, folder).select("CustomerID", "cluster", *CENTROID_COLUMNS)
    return plain(clusters.cluster_quality(table, CENTROID_COLUMNS))


@query("m10_silhouette")
def _(spark, folder):
    table = by_remainder(spark, folder).select("CustomerID", "cluster", *CENTROID_COLUMNS)
    value = clusters.silhouette(table, CENTROID_COLUMNS)
    return plain(spark.createDataFrame([(value,)], "silhouette double"))


@query("m10_elbow")
def _(spark, folder):
    scaled = cut_lineage(scaling.standardize(stored_customers(spark, folder)))
    reduced = cut_lineage(reduction.fit_components(scaled, numbers(scaled)).transform(scaled))
    axes = [c for c in reduced.columns if c != "CustomerID"]
    return plain(spark.createDataFrame(clusters.cost_by_k(reduced, axes, range(2, 6)), "k int, cost double"))


# ---------------------------------------------------------------- recommendations


@query("rec1_best_sellers")
def _(spark, folder):
    return recommend.best_sellers(*shop(spark, folder))


@query("rec2_top10")
def _(spark, folder):
    return recommend.top_products(recommend.best_sellers(*shop(spark, folder)))


@query("rec3_purchases")
def _(spark, folder):
    return recommend.purchases(*shop(spark, folder))


@query("rec4_candidates")
def _(spark, folder):
    return recommend.candidates(*shop(spark, folder))


@query("rec5_wide")
def _(spark, folder):
    lines, customers = shop(spark, folder)
    return recommend.recommend(lines, customers.select("CustomerID", "cluster"))


@query("rec6_recommend")
def _(spark, folder):
    return plain(recommend.recommend(*shop(spark, folder)))


@query("segment_customers")
def _(spark, folder):
    return plain(segmentation.segment(retail_lines(spark, folder), VIEW_SETTINGS).customers)


@query("segment_and_recommend")
def _(spark, folder):
    return plain(segmentation.run(retail_lines(spark, folder), VIEW_SETTINGS))
