"""Standard scaling with the population deviation."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNSCALED = ("CustomerID", "Is_UK", "Day_Of_Week")


@dataclass(frozen=True)
class Scaler:
    """Mean and deviation of each scaled column."""

    stats: dict[str, tuple[float, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        """A constant column becomes 0; the columns keep their places."""

        def scaled(c: str) -> Column:
            mean, deviation = self.stats[c]
            centred = F.col(c).cast("double") - F.lit(mean)
            return centred * 0 if deviation == 0 else centred / F.lit(deviation)

        return df.select(*[scaled(c).alias(c) if c in self.stats else F.col(c) for c in df.columns])


def columns_to_scale(df: DataFrame, excluded: Iterable[str] = UNSCALED) -> list[str]:
    return sorted(set(df.columns) - set(excluded))


def fit_scaler(df: DataFrame, columns: list[str]) -> Scaler:
    """One aggregate over the rows; two numbers per column come back."""
    numbers = [F.col(c).cast("double") for c in columns]
    row = df.agg(*[F.avg(n) for n in numbers], *[F.stddev_pop(n) for n in numbers]).first()
    values = [0.0 if value is None else value for value in row]
    return Scaler(dict(zip(columns, zip(values[: len(columns)], values[len(columns) :]), strict=True)))


def standardize(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = columns_to_scale(df) if columns is None else columns
    return fit_scaler(df, columns).transform(df)
