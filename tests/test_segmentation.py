"""The whole computation, and every query against its SQL."""

from __future__ import annotations

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shelfwise.plans.oracles import ORACLES
from shelfwise.plans.queries import QUERIES
from shelfwise import __main__ as command
from shelfwise.config import Settings
from shelfwise.operators.features import feature_columns
from shelfwise.plans.segmentation import run, segment
from shelfwise.sources import transactions as io
from shelfwise.sources.retail_view import VIEW_SETTINGS, retail_lines

SLOTS = [f"Rec{i}_{part}" for i in (1, 2, 3) for part in ("StockCode", "Description")]


def comparable(pdf):
    def one(value):
        if value is None or value is pd.NA or value != value:
            return None
        if isinstance(value, (int, float)) or hasattr(value, "item"):
            return round(float(value), 6)
        return str(value)

    ordered = pdf[sorted(pdf.columns)]
    rows = [tuple(one(v) for v in row) for row in ordered.itertuples(index=False)]
    return sorted(rows, key=lambda row: [(v is None, str(v)) for v in row])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, small, name):
    found = entry.queries()[name](spark, small).toPandas()
    expected = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert len(found) > 0
    assert comparable(found) == comparable(expected)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, small, name):
    assert entry.queries()[name](spark, small).count() > 0


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == ["CustomerID", *feature_columns(), "cluster", *SLOTS]
    assert result.count() == 150


@pytest.fixture(scope="module")
def segments(spark, small):
    return segment(retail_lines(spark, small), VIEW_SETTINGS)


def test_segments(segments):
    everyone, outside = segments.features.count(), segments.outliers.count()
    customers = segments.customers.toPandas()
    assert outside == pytest.approx(0.05 * everyone, abs=1)
    assert len(customers) == everyone - outside == customers["CustomerID"].nunique()
    assert customers.columns.tolist() == ["CustomerID", *feature_columns(), "cluster"]
    sizes = customers["cluster"].value_counts()
    assert sorted(sizes.index) == [0, 1, 2] and sizes[0] >= sizes[1] >= sizes[2]
    assert segments.components.columns == ["CustomerID", *[f"PC{i}" for i in range(1, 7)], "cluster"]
    assert set(segments.outliers.columns) == {"CustomerID", *feature_columns(), "Outlier_Scores", "Is_Outlier"}


def test_outliers_have_no_part_in_the_best_sellers(spark, segments):
    lines = segments.lines.toPandas()
    customers = segments.customers.select("CustomerID", "cluster").toPandas()
    sold = lines.merge(customers, on="CustomerID")
    best = sold.groupby(["cluster", "StockCode", "Description"])["Quantity"].sum().reset_index()
    best = best.sort_values(["cluster", "Quantity"], ascending=[True, False], kind="stable")
    first = best.groupby("cluster").head(10)
    from shelfwise.operators.recommend import recommend

    for row in recommend(segments.lines, segments.customers).select("CustomerID", "cluster", *SLOTS).collect():
        has = set(sold.loc[sold["CustomerID"] == row["CustomerID"], "StockCode"])
        left = [c for c in first.loc[first["cluster"] == row["cluster"], "StockCode"] if c not in has][:3]
        assert [row[f"Rec{i}_StockCode"] for i in (1, 2, 3)] == left + [None] * (3 - len(left))


def test_fixed_labels_are_applied(spark, small):
    plain = Settings(home_country="NATION_0", trees=10, starts=2)
    swapped = Settings(home_country="NATION_0", trees=10, starts=2, label_map={0: 1, 1: 2, 2: 0}, with_rate=True)
    result = run(retail_lines(spark, small), swapped)
    assert len(result.columns) == 23 and len(run(retail_lines(spark, small), plain).columns) == 22
    assert {r[0] for r in result.select("cluster").distinct().collect()} == {0, 1, 2}


def test_command_reads_and_writes_csv(spark, small, tmp_path, capsys):
    lines = retail_lines(spark, small).withColumn("InvoiceDate", F.date_format("InvoiceDate", io.DATE_PATTERN))
    lines.write.option("header", True).csv(str(tmp_path / "lines"))
    command.main([str(tmp_path / "lines"), str(tmp_path / "out")])
    assert "Rec1_StockCode" in capsys.readouterr().out
    back = spark.read.option("header", True).csv(str(tmp_path / "out")).toPandas()
    assert back.columns.tolist() == ["CustomerID", *feature_columns(), "cluster", *SLOTS]
    assert back["CustomerID"].str.endswith(".0").all()
    assert math.isclose(len(back), 146, abs_tol=2)
    command.main([str(tmp_path / "lines")])
    assert "cluster" in capsys.readouterr().out
