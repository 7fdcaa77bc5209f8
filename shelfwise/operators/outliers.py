"""Isolation forest after Liu, Ting and Zhou (ICDM 2008), and the outlier split.

The forest is grown from small samples, one group of rows per tree, and then
scores all rows in vectorised batches.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.aggregates import exact_quantile

# Executors need not have this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEY = "CustomerID"
EULER_GAMMA = 0.5772156649015329
WIDTH = 4_294_967_291  # of ranks: the greatest prime below 2 ** 32


def expected_path(rows: int | np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search in a tree of that many rows."""
    n = np.asarray(rows, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + EULER_GAMMA
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class IsolationForest:
    """Trees as arrays with one row per tree and one entry per node; a leaf is
    its own child."""

    columns: list[str]
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray  # path length at a leaf, over the tree's expected length
    height: int

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """Anomaly score in (0, 1]; higher is more isolated."""
        trees = (self.feature, self.threshold, self.left, self.right, self.path)
        height = self.height
        # at most trees * (2 * tree_rows - 1) nodes
        shared = df.sparkSession.sparkContext.broadcast(trees)

        @F.pandas_udf("double")
        def forest_score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for batch in batches:
                rows = np.column_stack([column.to_numpy(float) for column in batch])
                yield pd.Series(score_rows(rows, shared.value, height))

        return df.withColumn(name, forest_score(*_numbers(self.columns)))


def score_rows(rows: np.ndarray, trees: tuple[np.ndarray, ...], height: int) -> np.ndarray:
    """All rows walk down one tree after the other."""
    total = np.zeros(len(rows))
    index = np.arange(len(rows))
    for feature, threshold, left, right, path in zip(*trees, strict=True):
        node = np.zeros(len(rows), dtype=np.int32)
        for _ in range(height):
            below = rows[index, feature[node]] <= threshold[node]
            node = np.where(below, left[node], right[node])
        total += path[node]
    return np.power(2.0, -total / len(trees[0]))


def sample_for_trees(df: DataFrame, columns: list[str], trees: int, rows: int, seed: int) -> DataFrame:
    """`rows` customers for each tree, without replacement, chosen by hash.

    A customer's MD5 gives two numbers, and these its rank for each tree. A
    rank below a share slightly above what is needed admits a customer to a
    tree; of those the lowest `rows` ranks stay. What is shuffled depends on
    trees and rows alone, and the choice does not depend on the partitioning.
    """
    total = df.count()
    wanted = min(1.0, (rows + 8 * math.sqrt(rows)) / max(total, 1))
    customer = F.md5(F.concat(F.col(KEY).cast("long").cast("string"), F.lit(f":{seed}")))
    first, second = (F.conv(F.substring(customer, at, 8), 16, 10).cast("long") for at in (1, 9))

    def rank(tree):
        return (F.col("first") + (tree + 1) * F.col("second")) % WIDTH

    admitted = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda tree: rank(tree) < int(wanted * WIDTH))
    numbers = [c.alias(name) for c, name in zip(_numbers(columns), columns, strict=True)]
    hashed = df.select(KEY, *numbers, first.alias("first"), second.alias("second"))
    drawn = hashed.select("*", F.explode(admitted).alias("tree")).withColumn("rank", rank(F.col("tree")))
    drawn = drawn.drop("first", "second")
    # few rows but costly trees: a fixed number of tasks, which is not merged for being small
    drawn = drawn.repartition(min(trees, df.sparkSession.sparkContext.defaultParallelism), "tree")
    by_tree = Window.partitionBy("tree").orderBy("rank", KEY)
    return drawn.withColumn("place", F.row_number().over(by_tree)).where(F.col("place") <= rows).drop("place", "rank")


def fit_isolation_forest(
    df: DataFrame, columns: list[str], trees: int = 100, tree_rows: int = 256, seed: int = 0
) -> IsolationForest:
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rows = pdf[columns].to_numpy(float)
        grown = grow_tree(rows, f"{seed}:{tree}")
        return pd.DataFrame([{"tree": tree, "rows": len(rows), **grown}])

    schema = (
        "tree int, rows int, feature array<int>, threshold array<double>, "
        "left array<int>, right array<int>, path array<double>"
    )
    sample = sample_for_trees(df, columns, trees, tree_rows, seed)
    # one row per tree, each with fewer than 2 * tree_rows nodes
    grown = sorted(sample.groupBy("tree").applyInPandas(grow, schema).collect(), key=lambda row: row["tree"])
    if not grown:
        raise ValueError("no rows to grow trees from")
    most = max(len(row["path"]) for row in grown)

    def table(name: str, dtype) -> np.ndarray:
        return np.array([list(row[name]) + [0] * (most - len(row[name])) for row in grown], dtype=dtype)

    expected = np.array([max(float(expected_path(row["rows"])), 1e-12) for row in grown])
    return IsolationForest(
        columns=list(columns),
        feature=table("feature", np.int32),
        threshold=table("threshold", float),
        left=table("left", np.int32),
        right=table("right", np.int32),
        path=table("path", float) / expected[:, None],
        height=height_limit(tree_rows),
    )


def height_limit(tree_rows: int) -> int:
    return math.ceil(math.log2(max(tree_rows, 2)))


def drawn(tree: str, number: int) -> tuple[int, float]:
    """What a node splits at, from the MD5 of its tree and number: a number to
    choose the feature by, and one in [0, 1) for the place between its ends."""
    digest = hashlib.md5(f"{tree}:{number}".encode()).hexdigest()
    return int(digest[:8], 16), int(digest[8:21], 16) / (1 << 52)


def grow_tree(rows: np.ndarray, tree: str) -> dict[str, list]:
    """Split at hash-drawn features and values until rows are alone, alike or
    at the height limit. Nodes are numbered from 1 at the root, the children
    of i are 2i and 2i + 1, so that no split depends on the order of growth."""
    nodes: dict[str, list] = {"feature": [], "threshold": [], "left": [], "right": [], "path": []}

    def add(members: np.ndarray, number: int) -> int:
        node, depth = len(nodes["path"]), number.bit_length() - 1
        nodes["feature"].append(0)
        nodes["threshold"].append(0.0)
        nodes["left"].append(node)
        nodes["right"].append(node)
        nodes["path"].append(depth + float(expected_path(len(members))))
        if len(members) < 2 or depth >= limit:
            return node
        low, high = members.min(axis=0), members.max(axis=0)
        varying = np.flatnonzero(high > low)
        if not len(varying):
            return node
        choice, place = drawn(tree, number)
        feature = int(varying[choice % len(varying)])
        threshold = float(low[feature] + place * (high[feature] - low[feature]))
        below = members[:, feature] <= threshold
        nodes["feature"][node], nodes["threshold"][node] = feature, threshold
        nodes["left"][node] = add(members[below], 2 * number)
        nodes["right"][node] = add(members[~below], 2 * number + 1)
        return node

    limit = height_limit(len(rows))
    add(rows, 1)
    return nodes


def contamination_threshold(scored: DataFrame, contamination: float = 0.05, score: str = "score") -> float:
    """The score above which the given share of rows lies."""
    threshold = exact_quantile(scored, score, 1 - contamination)
    return math.inf if threshold is None else threshold


def flag_outliers(scored: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """Outlier_Scores is -1 for an outlier and 1 otherwise, Is_Outlier 1 or 0."""
    outlier = F.when(F.col(score) > threshold, -1).otherwise(1)
    return (
        scored.withColumn("Outlier_Scores", outlier)
        .withColumn("Is_Outlier", F.when(F.col("Outlier_Scores") == -1, 1).otherwise(0))
        .drop(score)
    )


def split_outliers(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inliers without the two flag columns, and outliers with them."""
    inliers = flagged.where(F.col("Is_Outlier") == 0).drop("Outlier_Scores", "Is_Outlier")
    return inliers, flagged.where(F.col("Is_Outlier") == 1)


def _numbers(columns: list[str]) -> list[Column]:
    """A missing feature, such as the home flag of a customer without any
    country, counts as zero in the models."""
    return [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
