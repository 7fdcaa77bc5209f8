"""Aggregations that several operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def most_counted(counters: list[Column]) -> Column:
    """The place of the greatest counter, the first one on a tie; null if all
    are 0."""
    span = len(counters)
    best = F.greatest(*[counter * span - i for i, counter in enumerate(counters)])
    return F.when(best > 0, F.pmod(-best, F.lit(span))).cast("int")


def is_most_frequent(key: str, value: str, count: str, condition: Column) -> Column:
    """Aggregate: whether `value` is the key with the greatest count, the first
    key in order winning a tie; null without any key."""
    of = [
        F.max(F.when(condition & which, F.col(count)))
        for which in (F.col(key) < value, F.col(key) == value, F.col(key) > value)
    ]
    before, own, after = [F.coalesce(n, F.lit(0)) for n in of]
    return F.when(F.greatest(*of).isNotNull(), (own > before) & (own >= after))


def mode_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """The commonest value for each key, counted in rows; the smallest value on
    a tie. Null values do not count.

    The counting aggregates on the map side by (key, value), so a key that
    holds most rows reaches its final task as one row per distinct value.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg((-F.count(F.lit(1))).alias("rows"))
    return counts.groupBy(key).agg(F.min(F.struct("rows", value))[value].alias(value))


def nth_smallest(values: DataFrame, rank: int, keep: int) -> float:
    """Exact order statistic (0-based) of the only column of `values`.

    Each pass brackets the rank with an approximate sketch and counts the rows
    on either side, so no pass shuffles or sorts the rows. At most `keep` of
    them, those left in the bracket, are read by the driver.
    """
    v = F.col(values.columns[0])
    inside = values
    size = inside.count()
    share = 1e-3
    while size > keep:
        at = (rank + 0.5) / size
        low, high = inside.agg(
            F.percentile_approx(v, [max(at - share, 0.0), min(at + share, 1.0)], 10_000)
        ).first()[0]
        below, at_low, between, at_high = inside.agg(
            F.count_if(v < low),
            F.count_if(v == low),
            F.count_if((v > low) & (v < high)),
            F.count_if(v == high) if low < high else F.lit(0),
        ).first()
        if rank < below:
            inside, size, share = inside.where(v < low), below, share * 2
        elif rank < below + at_low:
            return low
        elif rank < below + at_low + between:
            inside, size, rank = inside.where((v > low) & (v < high)), between, rank - below - at_low
        elif rank < below + at_low + between + at_high:
            return high
        else:
            rank -= below + at_low + between + at_high
            inside, size, share = inside.where(v > high), size - below - at_low - between - at_high, share * 2
    return sorted(row[0] for row in inside.collect())[rank]


def exact_quantile(df: DataFrame, column: str, share: float, keep: int = 100_000) -> float | None:
    """Quantile with linear interpolation between neighbouring values.

    Sketches alone are not exact, and an exact percentile aggregate holds all
    distinct values in one task; this does neither.
    """
    v = F.col(column).cast("double")
    values = df.where(v.isNotNull() & ~F.isnan(v)).select(v.alias("value"))
    total = values.count()
    if total == 0:
        return None
    position = share * (total - 1)
    rank = math.floor(position)
    lower = nth_smallest(values, rank, keep)
    if position == rank:
        return lower
    up_to, following = values.agg(
        F.count_if(F.col("value") <= lower), F.min(F.when(F.col("value") > lower, F.col("value")))
    ).first()
    upper = lower if up_to > rank + 1 else following
    return lower + (upper - lower) * (position - rank)
