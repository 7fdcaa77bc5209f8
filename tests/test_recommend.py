from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from toy import settings, toy_lines

from shelfwise.functions import joins
from shelfwise.operators import recommend
from shelfwise.operators.cleaning import clean

SLOTS = [f"Rec{i}_{part}" for i in (1, 2, 3) for part in ("StockCode", "Description")]


def brute_force(lines: pd.DataFrame, customers: pd.DataFrame, top_n=10, k=3):
    """The same by plain loops: {customer: [(code, description), ...]}."""
    sold = lines.merge(customers, on="CustomerID")
    best = sold.groupby(["cluster", "StockCode", "Description"])["Quantity"].sum().reset_index()
    best = best.sort_values(["cluster", "Quantity"], ascending=[True, False], kind="stable")
    found = {}
    for cluster, members in customers.groupby("cluster"):
        top = best[best["cluster"] == cluster].head(top_n)
        for customer in members["CustomerID"]:
            has = set(sold.loc[sold["CustomerID"] == customer, "StockCode"])
            left = [(c, d) for c, d in zip(top["StockCode"], top["Description"]) if c not in has]
            found[customer] = left[:k]
    return found


def random_lines(seed=11, n=4000):
    """A third of all lines belong to one customer and one product."""
    random = np.random.default_rng(seed)
    customer = random.integers(0, 60, n)
    code = random.integers(10, 45, n)
    customer[: n // 3], code[: n // 3] = 7, 10
    return pd.DataFrame(
        {
            "CustomerID": customer,
            "StockCode": code.astype(str),
            "Description": np.where(random.random(n) < 0.3, "OTHER ", "") + pd.Series(code.astype(str)),
            "Quantity": random.integers(-2, 4, n),
            "InvoiceNo": random.integers(0, 500, n).astype(str),
        }
    )


def wide_rows(df):
    return {r["CustomerID"]: [r[c] for c in SLOTS] for r in df.collect()}


@pytest.fixture(scope="module")
def toy(spark):
    lines = clean(toy_lines(spark)).cache()
    customers = spark.createDataFrame([(1, 0), (2, 0)], "CustomerID long, cluster int")
    return lines, customers


def test_best_sellers_of_the_toy_table(toy):
    lines, customers = toy
    top = recommend.top_products(recommend.best_sellers(lines, customers)).orderBy("Rank").collect()
    assert [(r["StockCode"], r["Description"], r["Quantity"]) for r in top] == [
        ("10001A", "RED MUG", 6), ("10003", "GREEN JUG", 3), ("10002", "BLUE BOWL", 1),
        ("22223", "NEXT DAY CARRIAGE", 1),
    ]


def test_customers_with_few_options_keep_empty_slots(toy):
    found = wide_rows(recommend.recommend(*toy))
    assert found[1] == ["22223", "NEXT DAY CARRIAGE", None, None, None, None]
    assert found[2] == ["10003", "GREEN JUG", "10002", "BLUE BOWL", None, None]


def test_nothing_left_to_recommend(spark, toy):
    lines, _ = toy
    one = spark.createDataFrame([(1, 0)], "CustomerID long, cluster int")
    assert wide_rows(recommend.recommend(lines, one)) == {1: [None] * 6}


@pytest.mark.parametrize("small, top_n", [(True, 10), (False, 10), (True, 70)])
def test_against_brute_force(spark, monkeypatch, small, top_n):
    """With customers that are all heavy, and none; with masks of one word, and two."""
    monkeypatch.setattr(joins, "HEAVY", 0.01 if small else 0.9)
    pdf = random_lines()
    customers = pd.DataFrame({"CustomerID": range(1, 60)})
    customers["cluster"] = customers["CustomerID"] % 3
    lines, assigned = spark.createDataFrame(pdf).repartition(6), spark.createDataFrame(customers)
    expected = brute_force(pdf, customers, top_n)
    limits = {} if small else {"spark.sql.autoBroadcastJoinThreshold": "-1"}
    with settings(spark, limits):
        found = wide_rows(recommend.recommend(lines, assigned, top_n=top_n))
        single = recommend.candidates(lines, assigned, top_n).orderBy("CustomerID", "Position").collect()
    assert set(found) == set(expected)
    for customer, products in expected.items():
        flat = [x for product in products for x in product]
        assert found[customer] == flat + [None] * (6 - len(flat)), customer
    assert [(r["CustomerID"], r["StockCode"], r["Description"]) for r in single] == [
        (c, *p) for c in sorted(expected) for p in expected[c]
    ]


def test_outlier_lines_do_not_count(spark):
    pdf = random_lines(3)
    customers = pd.DataFrame({"CustomerID": range(60), "cluster": [0] * 60})
    outside = spark.createDataFrame([(7,), (8,)], "CustomerID long")
    lines, assigned = spark.createDataFrame(pdf), spark.createDataFrame(customers)
    kept = customers[~customers["CustomerID"].isin([7, 8])]
    expected = brute_force(pdf[~pdf["CustomerID"].isin([7, 8])], kept)
    found = wide_rows(recommend.recommend(lines, assigned, outside))
    assert {c: [x for x in row[::2] if x] for c, row in found.items()} == {
        c: [code for code, _ in products] for c, products in expected.items()
    }


@pytest.mark.parametrize("heavy", [0.01, 0.9])
def test_line_joins_keep_every_line(spark, monkeypatch, heavy):
    monkeypatch.setattr(joins, "HEAVY", heavy)
    pdf = random_lines(4)
    lines = spark.createDataFrame(pd.concat([pdf, pdf.head(50)]))  # equal lines, too
    outside = spark.createDataFrame([(7,), (8,)], "CustomerID long")
    assigned = spark.createDataFrame([(7, 1), (9, 0)], "CustomerID long, cluster int")

    def rows(df):
        return sorted(map(tuple, df.collect()))

    all_rows = [tuple(r) for r in lines.collect()]
    assert rows(recommend.drop_outlier_lines(lines, outside)) == sorted(r for r in all_rows if r[0] not in (7, 8))
    cluster = {7: 1, 9: 0}
    assert rows(recommend.lines_with_cluster(lines, assigned)) == sorted(
        (*r, cluster[r[0]]) for r in all_rows if r[0] in cluster
    )


def test_features_come_along(spark, toy):
    lines, customers = toy
    wide = recommend.recommend(lines, customers.withColumn("Total_Spend", F.lit(1.0)))
    assert wide.columns == ["CustomerID", "Total_Spend", "cluster", *SLOTS]


def test_purchases_ignore_repeats(toy):
    lines, customers = toy
    rows = recommend.purchases(lines, customers).orderBy("CustomerID", "StockCode").collect()
    assert [(r["CustomerID"], r["StockCode"]) for r in rows] == [
        (1, "10001A"), (1, "10002"), (1, "10003"), (2, "10001A"), (2, "22223"),
    ]


def test_plan_limits_before_the_shuffle_and_broadcasts_top_lists(spark, toy, capsys):
    lines, customers = toy
    with settings(spark, {"spark.sql.adaptive.enabled": "false"}):
        recommend.top_products(recommend.best_sellers(lines, customers)).explain()
        best = capsys.readouterr().out
        recommend.recommend(lines, customers).explain()
    plan = capsys.readouterr().out
    assert best.index("Final") < best.index("Exchange hashpartitioning(cluster") < best.index("Partial")
    assert "WindowGroupLimit" in best and "WindowGroupLimit" not in plan  # the lists are computed once
    assert "LeftSemi" in plan and "BroadcastHashJoin" in plan
    for each in (best, plan):
        assert "CartesianProduct" not in each and "NestedLoop" not in each and "Python" not in each


def test_heavy_customers_are_found(spark):
    lines = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, 8).otherwise(F.col("id")).cast("long").alias("CustomerID")
    )
    assert joins.heavy_keys(lines, "CustomerID") == [7, 8]
    assert joins.heavy_keys(lines.where("false"), "CustomerID") == []


def test_only_heavy_customers_are_repeated(spark, capsys):
    lines = spark.range(3000).select(F.when(F.col("id") < 1500, 1).otherwise(F.col("id")).alias("CustomerID"), "id")
    keyed = spark.range(3000).select(F.col("id").alias("CustomerID"), F.lit(0).alias("cluster"))
    with settings(spark, {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}):
        joined = joins.join_by_customer(lines, keyed, "CustomerID")
        joined.explain()
    plan = capsys.readouterr().out
    assert plan.count("hashpartitioning(CustomerID#") == 2 and plan.count("salt#") > 2 and "Broadcast" not in plan
    assert joined.count() == 3000


def test_long_lists_are_cut_before_they_meet(spark, capsys):
    """Beyond what Spark limits by itself, a cluster's products are ranked in shares first."""
    rows = spark.range(30_000).select(
        (F.col("id") % 2).alias("cluster"), F.col("id").cast("string").alias("StockCode"),
        F.lit("X").alias("Description"), (F.xxhash64("id") % 1000).alias("Quantity"),
    )
    with settings(spark, {"spark.sql.adaptive.enabled": "false"}):
        recommend.top_products(rows, 5000).explain()
    plan = capsys.readouterr().out
    assert plan.count("Window [") == 2 and "hashpartitioning(cluster#" in plan.split("salt#")[0]
    found = recommend.top_products(rows, 5000).toPandas()
    pdf = rows.toPandas().sort_values(["cluster", "Quantity", "StockCode"], ascending=[True, False, True])
    expected = pdf.groupby("cluster").head(5000)
    found = found.sort_values(["cluster", "Rank"])
    assert found["StockCode"].tolist() == expected["StockCode"].tolist()


def test_masks_have_no_sets(spark, toy, capsys):
    lines, customers = toy
    lists = recommend.stored_lists(lines, customers, 10)
    recommend.bought_masks(lines, customers, lists, 10).explain()
    plan = capsys.readouterr().out
    assert "bit_or" in plan and "collect_set" not in plan and "ObjectHashAggregate" not in plan
