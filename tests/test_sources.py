from __future__ import annotations

import csv
import datetime
import glob
import os

import pytest
from pyspark.sql import functions as F
from toy import settings

from shelfwise.session import configured_folder, dropping_stored, new_path, shared_folder, store
from shelfwise.sources import transactions as io

HEADER = "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n"


def write(tmp_path, *rows):
    path = tmp_path / "lines.csv"
    path.write_bytes((HEADER + "\n".join(rows) + "\n").encode("latin-1"))
    return str(path)


def test_text_is_latin_and_types_are_declared(spark, tmp_path):
    path = write(tmp_path, '536365,85123A,"CAFÉ ""£5"" MUG, RED",6,12/1/2010 8:26,2.55,17850.0,United Kingdom')
    row = io.read_transactions(spark, path).first()
    assert row["Description"] == 'CAFÉ "£5" MUG, RED'
    assert row["InvoiceDate"] == datetime.datetime(2010, 12, 1, 8, 26)
    assert (row["Quantity"], row["UnitPrice"], row["CustomerID"]) == (6, 2.55, 17850.0)


def test_null_markers(spark, tmp_path):
    path = write(tmp_path, "1,NA,,1,NaN,nan,n/a,None", "2,22,x,2,1/2/2011 9:05,NULL,<NA>,na")
    first, second = io.read_transactions(spark, path).orderBy("InvoiceNo").collect()
    assert [first[c] for c in ("StockCode", "Description", "InvoiceDate", "UnitPrice", "CustomerID", "Country")] == [
        None
    ] * 6
    assert second["UnitPrice"] is None and second["CustomerID"] is None and second["Country"] == "na"


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), "NaN", 1), (1.0, "x", 2)], "a double, b string, c int")
    assert [tuple(r) for r in io.normalize_nulls(df).collect()] == [(None, None, 1), (1.0, "x", 2)]


def test_junk_raises_or_becomes_null(spark, tmp_path):
    path = write(tmp_path, "1,22222,x,1,not a date,1.0,1,UK")
    with pytest.raises(Exception):
        io.read_transactions(spark, path).collect()
    assert io.read_transactions(spark, path, lenient_dates=True).first()["InvoiceDate"] is None
    path = write(tmp_path, "1,22222,x,many,1/2/2011 9:05,1.0,1,UK")
    with pytest.raises(Exception):
        io.read_transactions(spark, path).collect()


def test_times_do_not_depend_on_the_time_zone(spark, tmp_path):
    path = write(tmp_path, "1,22222,x,1,3/28/2021 2:30,1.0,1,UK")
    with settings(spark, {"spark.sql.session.timeZone": "Europe/Paris"}):  # an hour that clocks skip there
        for lenient in (False, True):
            row = io.read_transactions(spark, path, lenient_dates=lenient).first()
            assert row["InvoiceDate"] == datetime.datetime(2021, 3, 28, 2, 30)


def test_sink_is_ordered_with_a_header_and_float_customers(spark):
    rows = [(20000000, 1, "b"), (3, 0, None), (1, 1, 'say "x", y')]
    df = spark.createDataFrame(rows, "CustomerID long, cluster int, Rec1_Description string")
    path = new_path(spark, "sink")
    io.write_recommendations(df, path)
    lines = []
    for part in sorted(glob.glob(path.removeprefix("file:") + "/part-*")):
        with open(part, newline="") as file:
            lines += list(csv.reader(file))[1:]
    assert lines == [["3.0", "0", ""], ["1.0", "1", 'say "x", y'], ["20000000.0", "1", "b"]]
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    assert back.columns == df.columns and back.count() == 3


def test_preview_and_sample(spark):
    df = spark.range(100).select(
        F.col("id").alias("CustomerID"), (F.col("id") % 3).alias("cluster"), *[F.lit(i).alias(f"c{i}") for i in range(6)]
    )
    assert [r["CustomerID"] for r in io.preview(df).collect()] == [0, 3, 6, 9, 12]
    one, other = (io.sample_rows(df.repartition(n)).collect() for n in (1, 7))
    assert one == other and len(one) == 10
    assert io.sample_rows(df).columns == ["CustomerID", *[f"c{i}" for i in range(6)]]
    assert io.sample_rows(df, seed=1).collect() != one
    assert io.sample_rows(df.limit(4)).count() == 4


def test_stored_tables_are_dropped(spark):
    if not configured_folder(spark):
        spark.sparkContext.setCheckpointDir(shared_folder(spark).removeprefix("file:"))
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with dropping_stored(spark):
        kept = store(spark.range(10), "kept")
        assert kept.count() == 10 and set(os.listdir(folder)) > before
    assert set(os.listdir(folder)) == before


def test_a_cluster_must_name_its_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://somewhere"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = Conf()

    with pytest.raises(RuntimeError):
        shared_folder(Session())


def test_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "lines.csv"
    path.write_text(
        "Extra,Description,StockCode,InvoiceNo,Quantity,UnitPrice,InvoiceDate,Country,CustomerID\n"
        "x,red mug,22222,1,2,1.5,1/2/2011 9:05,UK,7\n"
    )
    row = io.read_transactions(spark, str(path)).first()
    assert row.asDict() == {
        "InvoiceNo": "1", "StockCode": "22222", "Description": "red mug", "Quantity": 2,
        "InvoiceDate": datetime.datetime(2011, 1, 2, 9, 5), "UnitPrice": 1.5, "CustomerID": 7.0, "Country": "UK",
    }


def test_missing_columns_and_surplus_fields_raise(spark, tmp_path):
    path = tmp_path / "short.csv"
    path.write_text("InvoiceNo,StockCode\n1,2\n")
    with pytest.raises(ValueError, match="CustomerID"):
        io.read_transactions(spark, str(path))
    with pytest.raises(Exception, match="more fields"):
        io.read_transactions(spark, write(tmp_path, "1,22222,x,1,1/2/2011 9:05,1.0,1,UK,surplus")).collect()
    short = io.read_transactions(spark, write(tmp_path, "1,22222,x,1,1/2/2011 9:05")).first()
    assert (short["Quantity"], short["Country"]) == (1, None)


def test_several_date_patterns_and_line_breaks(spark, tmp_path):
    path = write(tmp_path, '1,22222,"red\nmug",1,2011-02-01 09:05,1.0,1,UK', "2,22222,x,1,2/1/2011 9:05,1.0,1,UK")
    lines = io.read_transactions(spark, path, date_pattern=["M/d/yyyy H:mm", "yyyy-MM-dd HH:mm"], multi_line=True)
    first, second = lines.orderBy("InvoiceNo").collect()
    assert first["Description"] == "red\nmug"
    assert first["InvoiceDate"] == second["InvoiceDate"] == datetime.datetime(2011, 2, 1, 9, 5)
