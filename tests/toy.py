"""Fifteen lines, each with a trap in it."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from shelfwise.functions.columns import parse_timestamp

UK, FR = "United Kingdom", "France"
ROWS = [
    ("100", "10001A", "Red Mug", 2, "1/4/2021 9:00", 2.5, 1.0, UK),
    ("100", "10002", "blue bowl", 1, "1/4/2021 9:00", 4.0, 1.0, UK),
    ("100", "10001A", "Red Mug", 2, "1/4/2021 9:00", 2.5, 1.0, UK),
    ("C101", "10001A", "Red Mug", -1, "1/12/2021 10:00", 2.5, 1.0, UK),
    ("102", "10003", "green jug", 3, "2/9/2021 10:00", 1.0, 1.0, FR),
    ("103", "POST", "POSTAGE", 1, "2/9/2021 10:00", 9.0, 1.0, FR),
    ("104", "C2", "CARRIAGE", 1, "2/9/2021 10:00", 9.0, 1.0, FR),
    ("105", "22222", "Next Day Carriage", 1, "2/9/2021 10:00", 9.0, 1.0, FR),
    ("106", "22223", "NEXT DAY CARRIAGE", 1, "2/10/2021 8:00", 5.0, 2.0, FR),
    ("107", "10002", "blue bowl", 1, "2/10/2021 8:00", 0.0, 2.0, FR),
    ("108", "10002", None, 1, "2/10/2021 8:00", 4.0, 2.0, FR),
    ("109", "10002", "blue bowl", 1, "2/10/2021 8:00", 4.0, None, FR),
    ("110", "10001A", "Red Mug", 1, "3/1/2021 12:00", 2.5, 3.0, FR),
    ("111", "10001A", "red mug", 5, "2/10/2021 11:00", 2.0, 2.0, None),
    ("112", "10002", "blue bowl", 1, "2/10/2021 11:00", float("nan"), 2.0, FR),
]
SCHEMA = (
    "InvoiceNo string, StockCode string, Description string, Quantity int, InvoiceDate string, "
    "UnitPrice double, CustomerID double, Country string"
)


def toy_lines(spark):
    lines = spark.createDataFrame(ROWS, SCHEMA)
    return lines.withColumn("InvoiceDate", parse_timestamp("InvoiceDate", "M/d/yyyy H:mm"))


@contextmanager
def settings(spark, values):
    before = {key: spark.conf.get(key) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def columns(df, *names):
    return [tuple(row) for row in df.select(*names).orderBy(*[F.col(n) for n in names]).collect()]
