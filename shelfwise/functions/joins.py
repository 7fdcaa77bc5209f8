"""Joins of lines to something per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A customer with this share of the lines is heavy, so there are at most 1 / HEAVY of them.
HEAVY = 0.01
#: Keys that the sketch tracks; it finds every one with more than a few of this many parts of the lines.
TRACKED = 4096
SALTS = 16


def heavy_keys(lines: DataFrame, key: str) -> list:
    """Every key with a `HEAVY` share of the lines, from a sketch of fixed size
    that one pass over the column makes."""
    top = F.call_function("approx_top_k", F.col(key), F.lit(round(1 / HEAVY)), F.lit(TRACKED))
    found, total = lines.where(F.col(key).isNotNull()).agg(top, F.count(F.lit(1))).first()
    return sorted(row["item"] for row in found if row["count"] >= HEAVY * total)


def join_by_customer(lines: DataFrame, keyed: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join lines to a few columns per customer, although one customer may
    hold a large part of the lines.

    The lines of heavy customers are spread over a few salts by a hash of their
    values, and only these customers are repeated for each salt. Whether the
    customer side is sent to all tasks is left to adaptive execution, which
    knows its size.
    """
    heavy = heavy_keys(lines, key)
    if not heavy:
        return lines.join(keyed, key, how)
    is_heavy = F.col(key).isin(heavy)
    salt = F.when(is_heavy, F.pmod(F.xxhash64(*lines.columns), F.lit(SALTS))).otherwise(0)
    salts = F.when(is_heavy, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(
        F.array(F.lit(0).cast("long"))
    )
    return lines.withColumn("salt", salt).join(keyed.withColumn("salt", F.explode(salts)), [key, "salt"], how).drop("salt")
