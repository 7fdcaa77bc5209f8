"""Places of rows within their group, whatever share of the rows one group holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.storage import stored


def ranked(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """`df` with `place` (from 0, by `order` ascending, nulls first) and `n`, the rows of the group.

    Rows are dealt out by ranges of (group, order), so that a large group spreads over many tasks; the rows that stand
    before a task's share come from a table with one row for each task and group. Rows that are equal in `order` get
    places in no stated order. Group columns must not be null; no column may be called `part`, `dealt`, `place`, `n`.
    """
    dealt = stored(
        df.withColumn("dealt", F.monotonically_increasing_id())
        .repartitionByRange(*group, *order, "dealt")
        .withColumn("part", F.spark_partition_id()),
        "dealt",
    )
    shares = dealt.groupBy("part", *group).agg(F.count("*").alias("share"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.select(
        "part",
        *group,
        F.coalesce(F.sum("share").over(before), F.lit(0)).alias("before"),
        F.sum("share").over(whole).alias("n"),
    )
    here = Window.partitionBy("part", *group).orderBy(*order, "dealt")
    placed = dealt.withColumn("here", F.row_number().over(here)).join(shares, ["part", *group])
    return placed.withColumn("place", F.col("before") + F.col("here") - 1).drop("part", "dealt", "here", "before")
