"""Column expressions over invoice lines. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# A digit is any decimal digit, or one of the superscript,
# subscript, circled and similar digits that have no place value.
DIGIT = (
    r"[\p{Nd}\x{B2}\x{B3}\x{B9}\x{1369}-\x{1371}\x{19DA}\x{2070}\x{2074}-\x{2079}"
    r"\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247C}\x{2488}-\x{2490}\x{24EA}"
    r"\x{24F5}-\x{24FD}\x{24FF}\x{2776}-\x{277E}\x{2780}-\x{2788}\x{278A}-\x{2792}"
    r"\x{10A40}-\x{10A43}\x{10E60}-\x{10E68}\x{11052}-\x{1105A}\x{1F100}-\x{1F10A}]"
)


def digit_count(code: str) -> Column:
    return F.regexp_count(F.col(code), F.lit(DIGIT))


def has_more_digits(code: str, count: int) -> Column:
    """Plain digits are counted without a pattern, which settles nearly all codes."""
    rest = F.translate(code, "0123456789", "")
    return (F.length(code) - F.length(rest) > count) | (digit_count(code) > count)


def transaction_status(invoice: str = "InvoiceNo") -> Column:
    return F.when(F.col(invoice).startswith("C"), "Cancelled").otherwise("Completed")


def is_cancelled(invoice: str = "InvoiceNo") -> Column:
    return F.coalesce(F.col(invoice).startswith("C"), F.lit(False))


def is_positive(value: str, type_name: str) -> Column:
    """Greater than zero; NaN is not, although Spark orders it above all numbers."""
    positive = F.col(value) > 0
    if type_name in ("double", "float"):
        return positive & ~F.isnan(value)
    return positive


def null_if_marker(value: str, markers: Iterable[str]) -> Column:
    return F.when(~F.col(value).isin(list(markers)), F.col(value))


def parse_timestamp(text: str, pattern: str, lenient: bool = False) -> Column:
    """A time without a zone, as written. Junk raises, or becomes null when
    lenient."""
    parsed = F.to_timestamp_ntz(F.col(text), F.lit(pattern))
    if lenient:
        return F.when(F.try_to_timestamp(F.col(text), F.lit(pattern)).isNotNull(), parsed)
    return parsed


def line_spend() -> Column:
    return F.col("UnitPrice") * F.col("Quantity")


def weekday(timestamp: str) -> Column:
    """Monday is 0."""
    return F.weekday(timestamp)


def flag(condition: Column) -> Column:
    return condition.cast("int")


def zero_if_null(value: str | Column) -> Column:
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(0))


def ratio(part: str | Column, whole: str | Column) -> Column:
    """Double division; null where the divisor is zero."""
    part = F.col(part) if isinstance(part, str) else part
    whole = F.col(whole) if isinstance(whole, str) else whole
    return F.try_divide(part.cast("double"), whole.cast("double"))


def squared_distance(columns: list[str], centroid: Iterable[float]) -> Column:
    terms = [(F.col(c) - F.lit(float(x))) ** 2 for c, x in zip(columns, centroid, strict=True)]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total
