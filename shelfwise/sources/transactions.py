"""Reading invoice lines and writing results."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.config import NULL_MARKERS
from shelfwise.functions.columns import null_if_marker, parse_timestamp

LINES = T.StructType(
    [
        T.StructField("InvoiceNo", T.StringType()),
        T.StructField("StockCode", T.StringType()),
        T.StructField("Description", T.StringType()),
        T.StructField("Quantity", T.IntegerType()),
        T.StructField("InvoiceDate", T.StringType()),
        T.StructField("UnitPrice", T.DoubleType()),
        T.StructField("CustomerID", T.DoubleType()),
        T.StructField("Country", T.StringType()),
    ]
)

DATE_PATTERN = "M/d/yyyy H:mm"
SURPLUS = "__surplus"


def normalize_nulls(df: DataFrame, markers: Iterable[str] = NULL_MARKERS) -> DataFrame:
    """Texts that stand for a missing value become null, and so does NaN."""
    markers = list(markers)

    def clean(field: T.StructField):
        if isinstance(field.dataType, T.StringType):
            return null_if_marker(field.name, markers).alias(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(field.name), F.col(field.name)).alias(field.name)
        return F.col(field.name)

    return df.select(*[clean(field) for field in df.schema])


def read_transactions(
    spark: SparkSession,
    path: str,
    schema: T.StructType = LINES,
    encoding: str = "ISO-8859-1",
    date_pattern: str | Sequence[str] = DATE_PATTERN,
    markers: Iterable[str] = NULL_MARKERS,
    lenient_dates: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """Scan CSV files with a header.

    Columns are found by the names in the header, in any order; a missing one
    raises, others are ignored. A line with more fields than the header raises,
    one with fewer is filled up with nulls. Columns are read as text and cast
    after the null markers are gone, so a marker in a number column is null
    while real junk raises. Of several date patterns the first that fits
    counts. `multi_line` allows line breaks inside quotes, at the price of
    unsplittable files.
    """

    def options(reader: DataFrameReader) -> DataFrameReader:
        return (
            reader.option("encoding", encoding)
            .option("quote", '"')
            .option("escape", '"')
            .option("multiLine", multi_line)
        )

    names = options(spark.read.option("header", True).option("inferSchema", False)).csv(path).columns
    missing = [field.name for field in schema if field.name not in names]
    if missing:
        raise ValueError(f"columns missing in {path}: {missing}")
    # one column beyond the header catches surplus fields
    texts = T.StructType([T.StructField(name, T.StringType()) for name in [*names, SURPLUS]])
    raw = options(spark.read.schema(texts).option("header", True).option("enforceSchema", True)).csv(path)
    checked = F.when(
        F.col(SURPLUS).isNotNull(), F.raise_error(F.concat(F.lit("more fields than in the header: "), F.col(SURPLUS)))
    ).otherwise(F.col(schema[0].name))
    raw = raw.select(*[(checked if i == 0 else F.col(f.name)).alias(f.name) for i, f in enumerate(schema)])
    typed = normalize_nulls(raw, markers)
    lines = typed.select(*[F.col(field.name).cast(field.dataType).alias(field.name) for field in schema])
    if "InvoiceDate" in lines.columns:
        patterns = [date_pattern] if isinstance(date_pattern, str) else list(date_pattern)
        # the last pattern raises on junk unless dates are lenient
        parsed = [parse_timestamp("InvoiceDate", p, lenient_dates or p != patterns[-1]) for p in patterns]
        lines = lines.withColumn("InvoiceDate", F.coalesce(*parsed))
    return lines


def write_recommendations(df: DataFrame, path: str) -> None:
    """CSV with a header, ordered by cluster and customer over all files."""
    whole = df["CustomerID"].cast("long").cast("string")
    (
        df.orderBy("cluster", "CustomerID")
        .withColumn("CustomerID", F.concat(whole, F.lit(".0")))
        .write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .csv(path)
    )


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.orderBy("cluster", "CustomerID").limit(n)


def sample_rows(df: DataFrame, n: int = 10, seed: int = 0) -> DataFrame:
    """The n rows whose customer has the least MD5: random in effect, the same
    on any partitioning. Shows the customer and the last six columns."""
    last = [c for c in df.columns[-6:] if c != "CustomerID"]
    customer = F.col("CustomerID").cast("long").cast("string")
    return df.orderBy(F.md5(F.concat(customer, F.lit(f":{seed}"))), "CustomerID").limit(n).select("CustomerID", *last)
