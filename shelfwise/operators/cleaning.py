"""Cleaning of invoice lines. The order of the steps carries meaning: copies
are dropped and services matched before descriptions are upper-cased."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.config import SERVICE_NAMES, Settings
from shelfwise.functions.columns import has_more_digits, is_positive, transaction_status


def drop_missing(df: DataFrame, columns: Iterable[str] = ("CustomerID", "Description")) -> DataFrame:
    return df.na.drop(subset=list(columns))


def dedupe(df: DataFrame) -> DataFrame:
    """Whole-row duplicates, nulls equal. Grouping by all columns collapses
    copies on the map side and spreads what is left over all tasks."""
    return df.dropDuplicates()


def with_status(df: DataFrame) -> DataFrame:
    return df.withColumn("Transaction_Status", transaction_status())


def stock_codes(df: DataFrame) -> DataFrame:
    return df.select("StockCode").distinct()


def anomalous_stock_codes(df: DataFrame, max_digits: int = 1) -> DataFrame:
    """A missing code counts as one without digits."""
    return stock_codes(df).where(~F.coalesce(has_more_digits("StockCode", max_digits), F.lit(False)))


def drop_anomalous(df: DataFrame, max_digits: int = 1) -> DataFrame:
    """A predicate on each row, so no list of codes is needed; null codes go too."""
    return df.where(has_more_digits("StockCode", max_digits))


def drop_service_lines(df: DataFrame, names: Iterable[str] = SERVICE_NAMES) -> DataFrame:
    return df.where(~F.col("Description").isin(list(names)))


def service_line_pct(df: DataFrame, names: Iterable[str] = SERVICE_NAMES) -> DataFrame:
    is_service = F.col("Description").isin(list(names)).cast("double")
    return df.agg((F.avg(is_service) * 100).alias("service_pct"))


def upper_description(df: DataFrame) -> DataFrame:
    return df.withColumn("Description", F.upper("Description"))


def positive_price(df: DataFrame) -> DataFrame:
    return df.where(is_positive("UnitPrice", df.schema["UnitPrice"].dataType.typeName()))


def clean(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return (
        df.transform(drop_missing)
        .withColumn("CustomerID", F.col("CustomerID").cast("long"))
        .transform(dedupe)
        .transform(with_status)
        .transform(drop_anomalous, settings.max_code_digits)
        .transform(drop_service_lines, settings.service_names)
        .transform(upper_description)
        .transform(positive_price)
    )


def sound_lines(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The lines that `clean` keeps, with their copies and as they are written:
    its other steps look at single lines, so copies can be dropped afterwards."""
    return (
        df.transform(drop_missing)
        .withColumn("CustomerID", F.col("CustomerID").cast("long"))
        .transform(drop_anomalous, settings.max_code_digits)
        .transform(drop_service_lines, settings.service_names)
        .transform(positive_price)
    )


def without_copies(sound: DataFrame) -> DataFrame:
    """The other half of `clean`, for `sound_lines`: copies are dropped before
    descriptions are upper-cased."""
    return sound.transform(dedupe).transform(with_status).transform(upper_description)
