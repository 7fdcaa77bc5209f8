"""k-means, cluster labels and measures of cluster quality."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from shelfwise.functions.columns import squared_distance
from shelfwise.operators.kmeans import best_of_starts

KEY = "CustomerID"


def fit_centroids(
    points: DataFrame,
    columns: list[str],
    k: int = 3,
    starts: int = 10,
    max_iterations: int = 100,
    seed: int = 0,
) -> tuple[list[list[float]], list[float]]:
    """Centroids of the cheapest of several starts, in a fixed order, and the
    cost of every start. Neither depends on how the points are partitioned."""
    centroids, costs = best_of_starts(points, columns, k, starts, max_iterations, seed)
    return sorted(centroids.tolist()), costs


def assign(points: DataFrame, columns: list[str], centroids: list[list[float]]) -> DataFrame:
    """Adds the number of the nearest centroid; the first one on a tie."""
    distances = F.array(*[squared_distance(columns, c) for c in centroids])
    return points.withColumn("cluster", (F.array_position(distances, F.array_min(distances)) - 1).cast("int"))


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("Customers"))


def frequency_labels(assigned: DataFrame) -> dict[int, int]:
    """New label for each old one: 0 for the largest cluster, and so on. The
    labels number the centroids, which are few."""
    sizes = cluster_sizes(assigned).collect()
    ranked = sorted(sizes, key=lambda row: (-row["Customers"], row["cluster"]))
    return {row["cluster"]: label for label, row in enumerate(ranked)}


def relabel(assigned: DataFrame, labels: Mapping[int, int] | None = None) -> DataFrame:
    """Renames clusters by a given map, or by frequency. A map that lacks one
    of the clusters is an error: its customers would be lost."""
    if labels is None:
        labels = frequency_labels(assigned)
    else:
        missing = {row["cluster"] for row in cluster_sizes(assigned).collect()} - set(labels)
        if missing:
            raise ValueError(f"no label for the clusters {sorted(missing)}")
    if not labels:
        return assigned
    new = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return assigned.withColumn("cluster", new[F.col("cluster")])


def append_cluster(customers: DataFrame, assigned: DataFrame) -> DataFrame:
    return customers.join(assigned.select(KEY, "cluster"), KEY)


# ---------------------------------------------------------------- quality


def _cluster_means(points: DataFrame, columns: list[str]) -> list[Row]:
    """One row for each cluster."""
    return points.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in columns]
    ).orderBy("cluster").collect()


def cluster_quality(points: DataFrame, columns: list[str]) -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin scores of labelled points, from two
    aggregates by cluster; only numbers per cluster reach the driver."""
    spark = points.sparkSession
    means = _cluster_means(points, columns)
    centres = np.array([[row[c] for c in columns] for row in means], dtype=float)
    n = np.array([row["n"] for row in means], dtype=float)
    squared = F.lit(None).cast("double")
    for row in means:
        inside = F.col("cluster").eqNullSafe(F.lit(row["cluster"]))
        squared = F.when(inside, squared_distance(columns, [row[c] for c in columns])).otherwise(squared)
    spread = (
        points.select("cluster", squared.alias("squared"))
        .groupBy("cluster")
        .agg(F.sum("squared").alias("within"), F.avg(F.sqrt("squared")).alias("radius"))
        .orderBy("cluster")
        .collect()
    )
    within = sum(row["within"] for row in spread)
    radius = np.array([row["radius"] for row in spread])
    overall = (centres * n[:, None]).sum(axis=0) / n.sum()
    between = (n * ((centres - overall) ** 2).sum(axis=1)).sum()
    k = len(means)
    harabasz = (between / (k - 1)) / (within / (n.sum() - k))
    apart = np.sqrt(((centres[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(apart, np.inf)
    bouldin = ((radius[:, None] + radius[None, :]) / apart).max(axis=1).mean()
    return spark.createDataFrame(
        [(k, float(harabasz), float(bouldin))], "clusters int, calinski_harabasz double, davies_bouldin double"
    )


def silhouette(points: DataFrame, columns: list[str]) -> float | None:
    """Mean silhouette by squared Euclidean distance; null without two clusters.

    The mean squared distance of a point to a cluster follows from the count,
    the sums and the squared sum of the cluster, so no pairs are looked at. A
    point alone in its cluster counts as 0. Coordinates are taken from their
    mean, which leaves distances as they are and keeps digits."""
    means = points.agg(*[F.avg(c) for c in columns]).first()
    if means[0] is None:
        return None
    centred = points.select("cluster", *[(F.col(c) - F.lit(m)).alias(c) for c, m in zip(columns, means, strict=True)])
    own = F.lit(0.0)
    for c in columns:
        own = own + F.col(c) ** 2
    centred = centred.withColumn("square", own)
    # one row for each cluster
    stats = centred.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.sum("square").alias("squares"), *[F.sum(c).alias(c) for c in columns]
    ).orderBy("cluster").collect()
    if len(stats) < 2:
        return None

    def summed(row: Row) -> Column:
        """Squared distances to all points of a cluster."""
        total = F.col("square") * row["n"] + row["squares"]
        for c in columns:
            total = total - F.col(c) * (2 * row[c])
        return F.greatest(total, F.lit(0.0))

    inside = [F.col("cluster").eqNullSafe(F.lit(row["cluster"])) for row in stats]
    within = F.coalesce(*[F.when(here, summed(row) / F.lit(max(row["n"] - 1, 1))) for here, row in zip(inside, stats, strict=True)])
    alone = F.coalesce(*[F.when(here, F.lit(row["n"] == 1)) for here, row in zip(inside, stats, strict=True)])
    others = [F.when(~here, summed(row) / F.lit(row["n"])) for here, row in zip(inside, stats, strict=True)]
    judged = centred.select(within.alias("a"), F.least(*others).alias("b"), alone.alias("alone"))
    value = F.when(F.col("alone") | (F.greatest("a", "b") == 0), 0.0).otherwise(
        F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))
    )
    return judged.agg(F.avg(value)).first()[0]


def cost_by_k(
    points: DataFrame, columns: list[str], ks: range, starts: int = 1, max_iterations: int = 100, seed: int = 0
) -> list[tuple[int, float]]:
    """Least cost for each number of clusters, to find the elbow."""
    return [(k, min(fit_centroids(points, columns, k, starts, max_iterations, seed)[1])) for k in ks]
