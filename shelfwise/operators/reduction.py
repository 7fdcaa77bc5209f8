"""Principal components of the customer features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Components:
    columns: list[str]
    means: np.ndarray
    loadings: np.ndarray  # columns x components
    explained: np.ndarray

    def transform(self, df: DataFrame, key: str = "CustomerID") -> DataFrame:
        """The key and PC1, PC2, ..., as plain arithmetic on the columns."""
        centred = [_number(c) - F.lit(float(m)) for c, m in zip(self.columns, self.means, strict=True)]
        components = []
        for i, weights in enumerate(self.loadings.T, start=1):
            total: Column = F.lit(0.0)
            for column, weight in zip(centred, weights, strict=True):
                total = total + column * F.lit(float(weight))
            components.append(total.alias(f"PC{i}"))
        return df.select(key, *components)


def fit_components(df: DataFrame, columns: list[str], k: int = 6) -> Components:
    """The covariance is a distributed sum; only its few numbers are decomposed
    in one place. In each component the largest loading is made positive."""
    numbers = df.select(*[_number(c).alias(c) for c in columns])
    vectors = VectorAssembler(inputCols=columns, outputCol="features").transform(numbers).select("features")
    model = PCA(k=k, inputCol="features", outputCol="components").fit(vectors)
    loadings = model.pc.toArray()
    largest = loadings[np.abs(loadings).argmax(axis=0), range(k)]
    means = numbers.agg(*[F.avg(c) for c in columns]).first()
    return Components(
        columns=list(columns),
        means=np.array([0.0 if m is None else m for m in means]),
        loadings=loadings * np.where(largest < 0, -1.0, 1.0),
        explained=model.explainedVariance.toArray(),
    )


def explained_variance(df: DataFrame, columns: list[str]) -> list[float]:
    """Share of the variance in each of all components, largest first."""
    return fit_components(df, columns, len(columns)).explained.tolist()


def covariance(df: DataFrame, columns: list[str]) -> DataFrame:
    """Population covariance of each pair of columns, one row per pair. The
    pairs are summed up on the map side, so only their few rows are shuffled."""
    names = F.array(*[F.lit(c) for c in columns])
    rows = df.select(F.array(*[_number(c) for c in columns]).alias("row"))
    first = rows.select("row", F.posexplode("row").alias("i", "x"))
    pairs = first.select("i", "x", F.posexplode(F.slice("row", F.col("i") + 1, len(columns))).alias("k", "y"))
    sums = pairs.groupBy("i", "k").agg(F.covar_pop("x", "y").alias("covariance"))
    return sums.select(
        names[F.col("i")].alias("first"), names[F.col("i") + F.col("k")].alias("second"), "covariance"
    )


def _number(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))
