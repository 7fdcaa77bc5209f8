from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from toy import settings, toy_lines

from shelfwise.config import Settings
from shelfwise.operators import features
from shelfwise.operators.cleaning import clean, sound_lines
from shelfwise.plans.queries import QUERIES
from shelfwise.session import configured_folder, dropping_stored, shared_folder, store
from shelfwise.sources.retail_view import VIEW_SETTINGS, retail_lines

EXPECTED = {
    "Days_Since_Last_Purchase": (20, 19),
    "Total_Transactions": (3, 2),
    "Total_Products_Purchased": (5, 6),
    "Total_Spend": (9.5, 15.0),
    "Average_Transaction_Value": (3.166667, 7.5),
    "Unique_Products_Purchased": (3, 2),
    "Average_Days_Between_Purchases": (12.0, 0.0),
    "Day_Of_Week": (0, 2),
    "Hour": (9, 8),
    "Is_UK": (1, 0),
    "Cancellation_Frequency": (1, 0),
    "Cancellation_Rate": (0.333333, 0.0),
    "Monthly_Spending_Mean": (4.75, 15.0),
    "Monthly_Spending_Std": (2.474874, 0.0),
    "Spending_Trend": (-3.5, 0.0),
}


@pytest.fixture(scope="module")
def lines(spark):
    return clean(toy_lines(spark)).cache()


def test_all_features_of_the_toy_table(lines):
    table = features.customer_features(lines, Settings(with_rate=True)).orderBy("CustomerID").toPandas()
    assert table["CustomerID"].tolist() == [1, 2]  # the third has one line only
    assert table.columns.tolist() == ["CustomerID", *EXPECTED]
    for name, values in EXPECTED.items():
        assert table[name].tolist() == pytest.approx(values, abs=1e-6), name


def test_rate_is_optional_and_columns_keep_their_order(lines):
    assert features.customer_features(lines).columns == ["CustomerID", *features.feature_columns()]
    assert len(features.feature_columns()) == 14 and len(features.feature_columns(True)) == 15


def test_single_feature_functions_agree_with_the_whole(spark, small):
    lines = clean(retail_lines(spark, small), VIEW_SETTINGS).cache()
    whole = features.customer_features(lines, replace(VIEW_SETTINGS, with_rate=True)).toPandas()
    whole = whole.set_index("CustomerID").sort_index()
    for make in (
        features.recency, features.transactions, features.quantity, features.spend, features.average_transaction,
        features.unique_products, features.favorite_day, features.favorite_hour, features.cancellations,
        features.cancellation_rate, features.monthly_stats, features.spending_trend, features.gap_closed_form,
        features.gap_by_window, lambda df: features.home_country(df, "NATION_0"),
    ):
        single = make(lines).toPandas().set_index("CustomerID")
        for name in single.columns:
            both = whole[[name]].join(single[name].rename("single"), how="left")
            assert np.allclose(both[name].astype(float), both["single"].astype(float), atol=1e-9), name


def test_gap_by_line_level_brute_force(spark, small):
    lines = clean(retail_lines(spark, small), VIEW_SETTINGS)
    days = lines.select("CustomerID", "InvoiceDate").toPandas().sort_values("InvoiceDate")
    days["day"] = days["InvoiceDate"].dt.normalize()
    expected = days.groupby("CustomerID")["day"].apply(lambda d: d.diff().dt.days.mean()).dropna()
    for make in (features.gap_closed_form, features.gap_by_window):
        found = make(lines).toPandas().set_index("CustomerID")["Average_Days_Between_Purchases"].sort_index()
        pd.testing.assert_series_equal(found, expected.sort_index(), check_names=False)


def test_a_customer_with_a_third_of_all_lines(spark):
    """One hot customer and one hot invoice, against plain pandas."""
    random = np.random.default_rng(5)
    n = 3000
    hot = np.arange(n) < n // 3
    pdf = pd.DataFrame(
        {
            "InvoiceNo": np.where(hot & (random.random(n) < 0.5), "7", random.integers(0, 900, n).astype(str)),
            "StockCode": random.integers(10, 60, n).astype(str),
            "Description": "THING",
            "Quantity": random.integers(-3, 9, n),
            "InvoiceDate": pd.Timestamp("2020-01-01") + pd.to_timedelta(random.integers(0, 24 * 400, n), "h"),
            "UnitPrice": random.integers(1, 900, n) / 4,
            "CustomerID": np.where(hot, 1, random.integers(2, 80, n)),
            "Country": random.choice(["United Kingdom", "France", "Spain"], n),
        }
    )
    found = features.customer_features(spark.createDataFrame(pdf)).toPandas().set_index("CustomerID").sort_index()
    pdf["spend"] = pdf["UnitPrice"] * pdf["Quantity"]
    by = pdf.groupby("CustomerID")
    many = by.size()[by.size() > 1].index
    assert found.index.tolist() == many.tolist()
    assert found["Total_Spend"].tolist() == pytest.approx(by["spend"].sum()[many].tolist())
    assert found["Total_Transactions"].tolist() == by["InvoiceNo"].nunique()[many].tolist()
    assert found["Unique_Products_Purchased"].tolist() == by["StockCode"].nunique()[many].tolist()
    weekday = pdf.groupby(["CustomerID", pdf["InvoiceDate"].dt.dayofweek]).size().groupby(level=0).idxmax()
    assert found["Day_Of_Week"].tolist() == [weekday[c][1] for c in many]
    country = pdf.groupby(["CustomerID", "Country"]).size().groupby(level=0).idxmax()
    assert found["Is_UK"].tolist() == [int(country[c][1] == "United Kingdom") for c in many]
    monthly = pdf.groupby(["CustomerID", pdf["InvoiceDate"].dt.to_period("M")])["spend"].sum()
    slope = monthly.groupby(level=0).apply(lambda y: np.polyfit(range(len(y)), y, 1)[0] if len(y) > 1 else 0.0)
    assert found["Spending_Trend"].tolist() == pytest.approx(slope[many].tolist(), abs=1e-6)


def test_missing_values(spark):
    """A line without a time counts in sums only; one without a country or an
    invoice does not make a group."""
    rows = [
        ("1", "10", "2021-01-04 09:00:00", None, 2),
        (None, "10", "2021-01-06 09:00:00", None, 3),
        ("2", None, None, None, 4),
    ]
    lines = spark.createDataFrame(rows, "InvoiceNo string, StockCode string, t string, Country string, Quantity int")
    lines = lines.select(
        "*", F.col("t").cast("timestamp").alias("InvoiceDate"), F.lit(1.0).alias("UnitPrice"),
        F.lit(5).cast("long").alias("CustomerID"), F.lit("X").alias("Description"),
    ).drop("t")
    row = features.customer_features(lines).first()
    assert (row["Total_Transactions"], row["Total_Products_Purchased"], row["Unique_Products_Purchased"]) == (2, 9, 1)
    assert row["Is_UK"] is None and row["Average_Days_Between_Purchases"] == 2.0
    assert (row["Day_Of_Week"], row["Monthly_Spending_Mean"]) == (0, 5.0)


def test_home_country_loses_a_tie_to_an_earlier_name(spark):
    rows = [(1, "B"), (1, "A"), (2, "B"), (2, "C"), (3, None)]
    lines = spark.createDataFrame(rows, "CustomerID long, Country string")
    home = {r[0]: r[1] for r in features.home_country(lines, "B").collect()}
    assert home == {1: 0, 2: 1, 3: None}


def test_feature_plan_has_no_python_and_no_join_shuffle(spark, small, capsys):
    with settings(spark, {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}):
        lines = store(clean(retail_lines(spark, small), VIEW_SETTINGS))
        features.customer_features(lines, VIEW_SETTINGS).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Pandas" not in plan and "Window" not in plan
    # fixed-width buffers only; what is joined is split by customer already, and
    # months are the only thing shuffled twice without a sum in between
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
    assert plan.count("Exchange hashpartitioning(CustomerID#") == 6
    assert [plan.count(f"Exchange {kind}") for kind in ("rangepartitioning", "RoundRobin", "SinglePartition")] == [0, 0, 0]
    assert plan.count("Expand") == 1


def test_trend_over_many_words_of_months(spark):
    """Months far apart, so that the bitmap of a customer has several words."""
    random = np.random.default_rng(9)
    rows = []
    for customer in range(40):
        months = random.choice(300, size=random.integers(1, 40), replace=False)
        for month in [*months, *months[:5]]:
            time = pd.Timestamp(1990 + month // 12, 1 + month % 12, 1 + customer % 28, int(month % 24))
            rows.append((f"{customer}-{month}", "10", int(random.integers(-5, 50)), time, 2.0, customer, "X"))
    names = ["InvoiceNo", "StockCode", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID", "Country"]
    pdf = pd.DataFrame(rows, columns=names)
    found = features.customer_features(spark.createDataFrame(pdf)).toPandas().set_index("CustomerID").sort_index()
    monthly = (pdf["UnitPrice"] * pdf["Quantity"]).groupby([pdf["CustomerID"], pdf["InvoiceDate"].dt.to_period("M")]).sum()
    slope = monthly.groupby(level=0).apply(lambda y: np.polyfit(range(len(y)), y, 1)[0] if len(y) > 1 else 0.0)
    assert found["Spending_Trend"].tolist() == pytest.approx(slope.tolist(), abs=1e-9)
    std = monthly.groupby(level=0).std().fillna(0.0)
    assert found["Monthly_Spending_Std"].tolist() == pytest.approx(std.tolist())


@pytest.mark.parametrize("name", ["j4_drop_outlier_lines", "a17_features", "a17_features_with_rate", "m9_append_cluster"])
def test_lines_are_joined_and_rid_of_copies_once(spark, small, capsys, name):
    """What reads the cleaned lines several times reads a stored table; the source tables aren't joined anew."""
    if not configured_folder(spark):
        spark.sparkContext.setCheckpointDir(shared_folder(spark).removeprefix("file:"))
    capsys.readouterr()
    with dropping_stored(spark):
        QUERIES[name](spark, small).explain(True)
    plan = capsys.readouterr().out
    assert "l_orderkey" not in plan and "StockCode" in plan


def test_a_small_side_is_sent_to_the_lines(spark, small, capsys):
    """The size of the outliers is known before lines are shuffled for them."""
    if not configured_folder(spark):
        spark.sparkContext.setCheckpointDir(shared_folder(spark).removeprefix("file:"))
    capsys.readouterr()
    with dropping_stored(spark):
        QUERIES["j4_drop_outlier_lines"](spark, small).explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_lines_of_a_customer_lie_together_unless_they_are_many(spark):
    """So that what a task sums up by customer is a row for each customer, on any number of tasks."""
    hot = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 500 + 1)
    lines = spark.range(0, 60_000, 1, 24).select(
        hot.cast("long").alias("CustomerID"), F.sha2(F.col("id").cast("string"), 256).alias("InvoiceNo")
    )
    keys = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    if not configured_folder(spark):
        spark.sparkContext.setCheckpointDir(shared_folder(spark).removeprefix("file:"))
    with dropping_stored(spark):
        with settings(spark, keys):
            together = store(features.customers_together(lines))
        placed = together.withColumn("file", F.input_file_name())
        files = dict(placed.groupBy("CustomerID").agg(F.count_distinct("file")).collect())
        assert together.exceptAll(lines).isEmpty() and together.count() == 60_000
    assert files.pop(0) > 2 and len(files) == 500 and sum(files.values()) < 2 * len(files)


def doubled(spark):
    """Lines of 60 customers with copies, of which one holds a third of all lines, and with nulls."""
    random = np.random.default_rng(11)
    n = 4000
    pdf = pd.DataFrame(
        {
            "InvoiceNo": [f"C{i}" if i % 9 == 0 else f"{i}" for i in random.integers(0, 700, n)],
            "StockCode": random.integers(10, 90, n).astype(str),
            "Description": random.choice(["Mug", "mug", "Bowl"], n),
            "Quantity": random.integers(-3, 9, n),
            "InvoiceDate": pd.Timestamp("2020-01-01") + pd.to_timedelta(random.integers(0, 24 * 900, n), "h"),
            "UnitPrice": random.integers(1, 900, n) / 4,
            "CustomerID": np.where(np.arange(n) < n // 3, 1, random.integers(2, 60, n)),
            "Country": random.choice(["United Kingdom", "France", "Spain"], n),
        }
    )
    lines = spark.createDataFrame(pd.concat([pdf, pdf[::3], pdf[::7]]))
    hole = F.xxhash64("InvoiceNo", "StockCode", "InvoiceDate")
    return lines.withColumns(
        {
            "InvoiceNo": F.when(hole % 11 != 0, F.col("InvoiceNo")),
            "InvoiceDate": F.when((hole % 13 != 0) & (F.col("CustomerID") != 7), F.col("InvoiceDate")),
            "Country": F.when((hole % 5 != 0) & (F.col("CustomerID") != 9), F.col("Country")),
            "CustomerID": F.when(hole % 17 != 0, F.col("CustomerID")).cast("long"),
        }
    )


@pytest.mark.parametrize("heavy", [0.01, 0.2, 1.0])
def test_lines_with_copies_have_the_features_of_clean_ones(spark, monkeypatch, heavy):
    """Whether many customers, one or none are spread out."""
    monkeypatch.setattr("shelfwise.functions.joins.HEAVY", heavy)
    monkeypatch.setattr(features, "DEALT", 1000)
    options, lines = Settings(with_rate=True), doubled(spark).cache()
    expected = features.customer_features(clean(lines), options).toPandas().set_index("CustomerID").sort_index()
    found = features.features_with_copies(sound_lines(lines), options).toPandas().set_index("CustomerID").sort_index()
    assert found.index.is_unique and len(found) > 50 and 7 not in found.index and found["Is_UK"].isna().any()
    pd.testing.assert_frame_equal(found, expected, check_dtype=False)
    assert features.features_with_copies(sound_lines(lines.limit(0)), options).isEmpty()


def test_stored_lines_are_shuffled_once(spark, small, capsys, monkeypatch):
    """Copies, sums, invoices, products, countries and months share one shuffle of the lines."""
    monkeypatch.setattr("shelfwise.functions.joins.HEAVY", 1.0)  # so few customers that each has a hundredth
    monkeypatch.setattr(features, "DEALT", 1000)
    if not configured_folder(spark):
        spark.sparkContext.setCheckpointDir(shared_folder(spark).removeprefix("file:"))
    keys = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    capsys.readouterr()
    with dropping_stored(spark), settings(spark, keys):
        QUERIES["a17_features"](spark, small).explain()
    plan = capsys.readouterr().out
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(CustomerID#" in line and "Reused" not in line]
    assert len(dealt) == 1 and plan.count("ReusedExchange") == 4
    assert "Expand" not in plan and "ObjectHashAggregate" not in plan and "Python" not in plan
