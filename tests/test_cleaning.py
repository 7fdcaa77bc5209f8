from __future__ import annotations

import pytest
from toy import ROWS, SCHEMA, columns, toy_lines

from shelfwise.operators import cleaning


@pytest.fixture(scope="module")
def lines(spark):
    return toy_lines(spark).cache()


def test_clean_keeps_the_expected_lines(lines):
    kept = cleaning.clean(lines)
    assert sorted(r["InvoiceNo"] for r in kept.collect()) == ["100", "100", "102", "106", "110", "111", "C101"]
    assert dict(kept.dtypes)["CustomerID"] == "bigint"


def test_copies_go_before_descriptions_are_upper_cased(spark):
    rows = [ROWS[0], ROWS[0][:2] + ("RED MUG",) + ROWS[0][3:], ROWS[0]]
    lines = spark.createDataFrame(rows, SCHEMA)
    assert [r["Description"] for r in cleaning.clean(lines).collect()] == ["RED MUG", "RED MUG"]


def test_equal_rows_with_nulls_are_copies(spark):
    rows = [("1", None), ("1", None), ("1", "x")]
    assert cleaning.dedupe(spark.createDataFrame(rows, "a string, b string")).count() == 2


def test_anomalous_codes(lines, spark):
    assert columns(cleaning.anomalous_stock_codes(lines), "StockCode") == [("C2",), ("POST",)]
    codes = spark.createDataFrame([(None,), ("A1",), ("A12",), ("A²3",), ("٣٤",), ("m",)], "StockCode string")
    assert columns(cleaning.drop_anomalous(codes), "StockCode") == [("A12",), ("A²3",), ("٣٤",)]
    assert {r[0] for r in cleaning.anomalous_stock_codes(codes).collect()} == {None, "A1", "m"}


def test_service_lines_match_exact_case(lines):
    present = cleaning.drop_anomalous(cleaning.dedupe(cleaning.drop_missing(lines)))
    assert cleaning.service_line_pct(present).first()[0] == pytest.approx(10.0)
    kept = {r["Description"] for r in cleaning.drop_service_lines(present).collect()}
    assert "NEXT DAY CARRIAGE" in kept and "Next Day Carriage" not in kept


def test_percentage_of_no_lines_is_null(lines):
    assert cleaning.service_line_pct(lines.limit(0)).first()[0] is None


def test_price_must_be_a_positive_number(lines, spark):
    assert {r["InvoiceNo"] for r in lines.collect()} - {
        r["InvoiceNo"] for r in cleaning.positive_price(lines).collect()
    } == {"107", "112"}
    exact = spark.sql("select cast(x as decimal(12,2)) as UnitPrice from values (0.00), (1.50), (-1.00), (null) t(x)")
    assert cleaning.positive_price(exact).count() == 1


def test_status_of_a_missing_invoice(spark):
    df = spark.createDataFrame([("C1",), ("1",), (None,)], "InvoiceNo string")
    assert [r[1] for r in cleaning.with_status(df).collect()] == ["Cancelled", "Completed", "Completed"]
