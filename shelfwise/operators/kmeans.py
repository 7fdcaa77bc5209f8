"""k-means with several starts that share every pass over the points.

A pass sums up, for all starts at once, what their centroids need: each task adds up its points in vectorised batches
and hands on a few numbers for each centroid. Sums are kept in whole numbers on a grid that is as fine as 64 bits allow,
so that they don't depend on the order of the points, and points are drawn by a hash of the customer. Centroids are
therefore the same on any partitioning.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Executors need not have this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEY = "CustomerID"
TOLERANCE = 1e-4  # of the mean variance, for the squared move of all centroids
ROUNDS = 2  # of drawing candidates for the starting centroids
ROWS_A_TASK = 4096
TASKS_A_CORE = 4
LOCAL_STEPS = 30

Measure = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Grid:
    """Whole numbers of 2 ** -bits; `reach` bounds what is summed up over `rows`."""

    bits: int

    @classmethod
    def for_sums(cls, reach: float, rows: int) -> Grid:
        return cls(61 - math.ceil(math.log2(max(reach, 1e-300))) - math.ceil(math.log2(max(rows, 1))))

    def on(self, values: np.ndarray) -> np.ndarray:
        return np.rint(np.ldexp(values, self.bits)).astype(np.int64)

    def off(self, total: np.ndarray) -> np.ndarray:
        return np.ldexp(np.asarray(total, dtype=float), -self.bits)


def squared_distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Rows x centroids, added up column by column: a row's numbers don't depend on the rows beside it."""
    total = np.zeros((len(rows), len(centroids)))
    for i in range(rows.shape[1]):
        total += (rows[:, i, None] - centroids[None, :, i]) ** 2
    return total


def uniform(draws: np.ndarray, start: int, turn: int) -> np.ndarray:
    """A number in [0, 1) for each row's hash, another one for each start and turn (the finish of splitmix64)."""
    x = draws.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (1 + turn + 1024 * start)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The columns after the first."""
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])


@dataclass(frozen=True)
class Points:
    """Points (draw, *columns), read again and again."""

    df: DataFrame
    rows: int
    sums: Grid
    costs: Grid

    def summed(self, measure: Measure) -> np.ndarray:
        """The sum over all points of what `measure` makes of a batch: whole numbers, as many for any batch."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                part = measure(_matrix(batch))
                total = part if total is None else total + part
            if total is not None:
                yield pa.record_batch([pa.array([total.tolist()], pa.list_(pa.int64()))], ["totals"])

        # a row for each task, of which there are a few for each core
        return np.sum([row["totals"] for row in self.df.mapInArrow(run, "totals array<long>").collect()], axis=0)

    def drawn(self, centroids: list[np.ndarray], costs: np.ndarray, wanted: int, turn: int) -> list[np.ndarray]:
        """For each start about `wanted` points, likelier the farther they are from its centroids."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = _matrix(batch)
                draws = batch.column(0).to_numpy(zero_copy_only=False)
                for start, (own, cost) in enumerate(zip(centroids, costs, strict=True)):
                    near = squared_distances(rows, own).min(axis=1)
                    taken = rows[uniform(draws, start, turn) * cost < wanted * near]
                    yield pa.record_batch(
                        [pa.array([start] * len(taken), pa.int32()), pa.array(taken.tolist(), pa.list_(pa.float64()))],
                        ["start", "row"],
                    )

        found: list[list[list[float]]] = [[] for _ in centroids]
        for row in self.df.mapInArrow(run, "start int, row array<double>").collect():
            found[row["start"]].append(row["row"])
        return [np.array(sorted(rows)).reshape(-1, centroids[0].shape[1]) for rows in found]

    def cost(self, centroids: list[np.ndarray]) -> np.ndarray:
        """The squared distance of all points to the nearest centroid, for each start."""
        grid = self.costs

        def measure(rows: np.ndarray) -> np.ndarray:
            return np.array([grid.on(squared_distances(rows, own).min(axis=1)).sum() for own in centroids])

        return grid.off(self.summed(measure))

    def members(self, centroids: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each start, how many points are nearest to each centroid, and their sum; the first centroid on a tie."""
        grid = self.sums

        def measure(rows: np.ndarray) -> np.ndarray:
            placed = grid.on(rows)
            distances = squared_distances(rows, np.vstack(centroids))
            parts, at = [], 0
            for own in centroids:
                nearest = distances[:, at : at + len(own)].argmin(axis=1)
                at += len(own)
                for c in range(len(own)):
                    inside = placed[nearest == c]
                    parts += [[len(inside)], inside.sum(axis=0)]
            return np.concatenate(parts).astype(np.int64)

        totals, found, at = self.summed(measure), [], 0
        for own in centroids:
            part = totals[at : at + own.size + len(own)].reshape(len(own), -1)
            at += part.size
            found.append((part[:, 0], grid.off(part[:, 1:])))
        return found


def prepared(points: DataFrame, columns: list[str], seed: int) -> Points:
    """The points with their hashes, held for the passes; free them by `df.unpersist()`."""
    drawn_by = [c for c in [KEY, *columns] if c in points.columns]
    numbers = [F.col(c).cast("double").alias(c) for c in columns]
    df = points.select(F.xxhash64(*drawn_by, F.lit(seed)).alias("draw"), *numbers)
    df.persist(StorageLevel.MEMORY_AND_DISK)
    rows, *reach = df.agg(F.count(F.lit(1)), *[F.max(F.abs(c)) for c in columns]).first()
    if not rows:
        raise ValueError("no points to cluster")
    # few tasks for few points, and few for each core for many; what is found doesn't depend on it
    tasks = min(math.ceil(rows / ROWS_A_TASK), TASKS_A_CORE * points.sparkSession.sparkContext.defaultParallelism)
    longest = max(reach)
    return Points(
        df.coalesce(tasks), rows, Grid.for_sums(longest, rows), Grid.for_sums(4 * len(columns) * longest**2, rows)
    )


def mean_variance(points: Points) -> float:
    sums, squares = points.sums, points.costs

    def measure(rows: np.ndarray) -> np.ndarray:
        return np.concatenate([sums.on(rows).sum(axis=0), squares.on(rows**2).sum(axis=0)])

    total, squared = np.split(points.summed(measure), 2)
    mean = sums.off(total) / points.rows
    return float(np.maximum(squares.off(squared) / points.rows - mean**2, 0).mean())


def starting_centroids(points: Points, k: int, starts: int, seed: int) -> list[np.ndarray]:
    """k centroids for each start, after k-means||: beginning with the point of the least hash, points are drawn by
    their squared distance in a few rounds, weighed by the points that are nearest to them, and boiled down to k."""
    columns = points.df.columns[1:]
    first = points.df.agg(
        *[F.min(F.struct(F.xxhash64("draw", F.lit(start)), *columns)).alias(str(start)) for start in range(starts)]
    ).first()
    found = [np.array([list(row)[1:]], dtype=float) for row in first]
    for turn in range(ROUNDS):
        more = points.drawn(found, points.cost(found), 2 * k, turn)
        found = [np.unique(np.vstack(pair), axis=0) for pair in zip(found, more, strict=True)]
    weights = [counts for counts, _ in points.members(found)]
    return [
        boiled_down(own, weight, k, np.random.default_rng([seed, start]))
        for start, (own, weight) in enumerate(zip(found, weights, strict=True))
    ]


def boiled_down(rows: np.ndarray, weights: np.ndarray, k: int, random: np.random.Generator) -> np.ndarray:
    """k centroids of a few weighted rows: k-means++ and some steps."""
    chosen = [int(random.choice(len(rows), p=weights / weights.sum()))]
    while len(chosen) < k:
        near = weights * squared_distances(rows, rows[chosen]).min(axis=1)
        # fewer rows than centroids: some centroids coincide
        chosen.append(int(random.choice(len(rows), p=near / near.sum())) if near.sum() > 0 else chosen[0])
    centroids = rows[chosen]
    for _ in range(LOCAL_STEPS):
        nearest = squared_distances(rows, centroids).argmin(axis=1)
        moved = centroids.copy()
        for c in range(k):
            inside = nearest == c
            if weights[inside].sum() > 0:
                moved[c] = np.average(rows[inside], axis=0, weights=weights[inside])
        if (moved == centroids).all():
            break
        centroids = moved
    return centroids


def lloyd(points: Points, centroids: list[np.ndarray], max_iterations: int, tolerance: float) -> list[np.ndarray]:
    """Moves the centroids of each start to the mean of their points until their squared moves are within `tolerance`;
    each pass over the points serves all starts that still move. A centroid without points stays."""
    centroids = list(centroids)
    moving = list(range(len(centroids)))
    for _ in range(max_iterations):
        if not moving:
            break
        still = []
        for start, (counts, sums) in zip(moving, points.members([centroids[s] for s in moving]), strict=True):
            old = centroids[start]
            centroids[start] = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], old)
            if ((centroids[start] - old) ** 2).sum() > tolerance:
                still.append(start)
        moving = still
    return centroids


def best_of_starts(
    df: DataFrame, columns: list[str], k: int, starts: int, max_iterations: int, seed: int
) -> tuple[np.ndarray, list[float]]:
    """The centroids of the start with the least cost, and the cost of every start. At most `max_iterations` passes over
    the points move the centroids, and nine others prepare and judge them."""
    points = prepared(df, columns, seed)
    try:
        begun = starting_centroids(points, k, starts, seed)
        ended = lloyd(points, begun, max_iterations, TOLERANCE * mean_variance(points))
        costs = points.cost(ended)
    finally:
        points.df.unpersist()
    return ended[int(costs.argmin())], costs.tolist()
