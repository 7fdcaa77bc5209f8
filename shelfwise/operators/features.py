"""Customer features from cleaned invoice lines.

Each feature has a function of its own. `customer_features` computes all of
them together without one pass per feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.config import Settings
from shelfwise.functions.aggregates import is_most_frequent, mode_by, most_counted
from shelfwise.functions.columns import (
    flag,
    is_cancelled,
    line_spend,
    ratio,
    weekday,
    zero_if_null,
)
from shelfwise.functions.joins import heavy_keys
from shelfwise.operators.cleaning import dedupe

KEY = "CustomerID"

FEATURES = [
    "Days_Since_Last_Purchase",
    "Total_Transactions",
    "Total_Products_Purchased",
    "Total_Spend",
    "Average_Transaction_Value",
    "Unique_Products_Purchased",
    "Average_Days_Between_Purchases",
    "Day_Of_Week",
    "Hour",
    "Is_UK",
    "Cancellation_Frequency",
    "Cancellation_Rate",
    "Monthly_Spending_Mean",
    "Monthly_Spending_Std",
    "Spending_Trend",
]


def feature_columns(with_rate: bool = False) -> list[str]:
    return [name for name in FEATURES if with_rate or name != "Cancellation_Rate"]


def with_line_columns(lines: DataFrame) -> DataFrame:
    """Day, spend, weekday, hour, year and month of each line."""
    return lines.withColumns(
        {
            "InvoiceDay": F.to_date("InvoiceDate"),
            "Total_Spend": line_spend(),
            "Day_Of_Week": weekday("InvoiceDate"),
            "Hour": F.hour("InvoiceDate"),
            "Year": F.year("InvoiceDate"),
            "Month": F.month("InvoiceDate"),
        }
    )


# ---------------------------------------------------------------- one feature each


def last_day(lines: DataFrame) -> DataFrame:
    return lines.groupBy(KEY).agg(F.max(F.to_date("InvoiceDate")).alias("InvoiceDay"))


def global_last_day(lines: DataFrame) -> DataFrame:
    """One row: the latest day in all lines."""
    return lines.agg(F.max(F.to_date("InvoiceDate")).alias("Most_Recent_Day"))


def recency(lines: DataFrame) -> DataFrame:
    latest = global_last_day(lines).scalar()
    return last_day(lines).select(KEY, F.datediff(latest, "InvoiceDay").alias("Days_Since_Last_Purchase"))


def transactions(lines: DataFrame) -> DataFrame:
    return lines.groupBy(KEY).agg(F.count_distinct("InvoiceNo").alias("Total_Transactions"))


def quantity(lines: DataFrame) -> DataFrame:
    return lines.groupBy(KEY).agg(zero_if_null(F.sum("Quantity")).alias("Total_Products_Purchased"))


def spend(lines: DataFrame) -> DataFrame:
    return lines.groupBy(KEY).agg(zero_if_null(F.sum(line_spend()).cast("double")).alias("Total_Spend"))


def average_transaction(lines: DataFrame) -> DataFrame:
    totals = lines.groupBy(KEY).agg(
        F.sum(line_spend()).alias("spend"), F.count_distinct("InvoiceNo").alias("invoices")
    )
    return totals.select(KEY, ratio("spend", "invoices").alias("Average_Transaction_Value"))


def unique_products(lines: DataFrame) -> DataFrame:
    return lines.groupBy(KEY).agg(F.count_distinct("StockCode").alias("Unique_Products_Purchased"))


def favorite_day(lines: DataFrame) -> DataFrame:
    return mode_by(lines.select(KEY, weekday("InvoiceDate").alias("Day_Of_Week")), KEY, "Day_Of_Week")


def favorite_hour(lines: DataFrame) -> DataFrame:
    return mode_by(lines.select(KEY, F.hour("InvoiceDate").alias("Hour")), KEY, "Hour")


def main_country(lines: DataFrame) -> DataFrame:
    """The country of most lines; a tie goes to the first in the alphabet."""
    return mode_by(lines.select(KEY, "Country"), KEY, "Country")


def home_country(lines: DataFrame, home: str) -> DataFrame:
    """Every customer; Is_UK is null for one without any country."""
    customers = lines.select(KEY).distinct()
    countries = main_country(lines).select(KEY, flag(F.col("Country") == home).alias("Is_UK"))
    return customers.join(countries, KEY, "left")


def cancellations(lines: DataFrame) -> DataFrame:
    return lines.groupBy(KEY).agg(
        F.count_distinct(F.when(is_cancelled(), F.col("InvoiceNo"))).alias("Cancellation_Frequency")
    )


def cancellation_rate(lines: DataFrame) -> DataFrame:
    """Cancelled share of a customer's invoices, matched by customer."""
    invoices = lines.where(F.col("InvoiceNo").isNotNull()).groupBy(KEY, "InvoiceNo").agg(
        F.max(is_cancelled()).alias("cancelled")
    )
    return invoices.groupBy(KEY).agg(
        ratio(F.count_if("cancelled"), F.count(F.lit(1))).alias("Cancellation_Rate")
    )


def monthly_spend(lines: DataFrame) -> DataFrame:
    """Months without lines have no row."""
    return (
        lines.where(F.col("InvoiceDate").isNotNull())
        .groupBy(KEY, F.year("InvoiceDate").alias("Year"), F.month("InvoiceDate").alias("Month"))
        .agg(zero_if_null(F.sum(line_spend()).cast("double")).alias("Total_Spend"))
    )


def monthly_stats(lines: DataFrame) -> DataFrame:
    return (
        monthly_spend(lines)
        .groupBy(KEY)
        .agg(
            F.avg("Total_Spend").alias("Monthly_Spending_Mean"),
            zero_if_null(F.stddev_samp("Total_Spend")).alias("Monthly_Spending_Std"),
        )
    )


def month_ordinals(lines: DataFrame) -> DataFrame:
    """Monthly spend with the position of the month among the customer's
    active months. A window holds one row per calendar month at most."""
    by_month = Window.partitionBy(KEY).orderBy("Year", "Month")
    return monthly_spend(lines).withColumn("Ordinal", F.row_number().over(by_month) - 1)


def spending_trend(lines: DataFrame) -> DataFrame:
    slope = F.regr_slope("Total_Spend", "Ordinal")
    return month_ordinals(lines).groupBy(KEY).agg(zero_if_null(slope).alias("Spending_Trend"))


def gap_closed_form(lines: DataFrame) -> DataFrame:
    """Mean day gap between consecutive lines. The gaps add up to last minus
    first day, so neither a window nor an order of the lines is needed."""
    day = F.to_date("InvoiceDate")
    days = lines.groupBy(KEY).agg(
        F.datediff(F.max(day), F.min(day)).alias("days"), F.count("InvoiceDate").alias("lines")
    )
    return days.where(F.col("lines") > 1).select(
        KEY, ratio(F.col("days"), F.col("lines") - 1).alias("Average_Days_Between_Purchases")
    )


def gap_by_window(lines: DataFrame) -> DataFrame:
    """The same mean by an explicit lag. Lines of one day have gaps of zero
    among them, so they are counted first and the window holds one row per
    calendar day at most, however many lines a customer has."""
    day = F.to_date("InvoiceDate")
    daily = lines.where(day.isNotNull()).groupBy(KEY, day.alias("day")).agg(F.count(F.lit(1)).alias("lines"))
    previous = F.lag("day").over(Window.partitionBy(KEY).orderBy("day"))
    gaps = daily.withColumn("gap", zero_if_null(F.datediff("day", previous)))
    totals = gaps.groupBy(KEY).agg(F.sum("gap").alias("days"), F.sum("lines").alias("lines"))
    return totals.where(F.col("lines") > 1).select(
        KEY, ratio(F.col("days"), F.col("lines") - 1).alias("Average_Days_Between_Purchases")
    )


def multi_line_customers(lines: DataFrame, min_lines: int = 2) -> DataFrame:
    """Customers that have a day gap at all; the others get no features."""
    counts = lines.groupBy(KEY).agg(F.count("InvoiceDate").alias("Lines"))
    return counts.where(F.col("Lines") >= min_lines)


# ---------------------------------------------------------------- all features

WORD = 60  # months in a word of a bitmap
#: Shares that customers are dealt into: so many that only a hot customer makes one too large for a task.
SHARES = 1024
#: Lines dealt to a task, so that its tables of groups stay small on any size of input.
DEALT = 1 << 17
#: Spark's own limit of buckets in a table.
MOST_TASKS = 100_000


def customers_together(lines: DataFrame) -> DataFrame:
    """The same lines with those of a customer side by side, for a table that is
    read by customer: whatever the number of tasks, what is summed up on the map
    side is then about a row for each customer and not one for each line. It is
    a rebalancing, so adaptive execution merges small shares and splits what a
    hot customer swells."""
    return lines.hint("rebalance", SHARES, F.col(KEY))


def month_number(timestamp: str) -> Column:
    return F.year(timestamp) * 12 + F.month(timestamp) - 1


def customer_sums(lines: DataFrame) -> DataFrame:
    """Sums over the lines of each customer, with a counter for each weekday
    and hour: of fixed width, so that they add up on the map side in place."""
    day, on, at = F.to_date("InvoiceDate"), weekday("InvoiceDate"), F.hour("InvoiceDate")
    counters = {f"weekday_{i}": F.count_if(on == i) for i in range(7)} | {f"hour_{i}": F.count_if(at == i) for i in range(24)}
    return lines.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(
        F.count("InvoiceDate").alias("lines"),
        F.min(day).alias("first_day"),
        F.max(day).alias("last_day"),
        zero_if_null(F.sum("Quantity")).alias("Total_Products_Purchased"),
        zero_if_null(F.sum(line_spend()).cast("double")).alias("Total_Spend"),
        *[counter.alias(name) for name, counter in counters.items()],
    )


def customer_sets(lines: DataFrame, home: str) -> DataFrame:
    """Counts of the invoices and products of each customer, and whether the
    country of most lines is `home`: three grouping sets in one shuffle."""
    by = ["InvoiceNo", "StockCode", "Country"]
    rows = lines.select(KEY, *by).groupingSets([[KEY, name] for name in by], KEY, *by).agg(
        *[(F.grouping(name) == 0).alias(f"by_{name}") for name in by], F.count(F.lit(1)).alias("rows")
    )
    invoice = F.col("by_InvoiceNo") & F.col("InvoiceNo").isNotNull()
    return rows.groupBy(KEY).agg(
        F.count_if(invoice).alias("Total_Transactions"),
        F.count_if(invoice & is_cancelled()).alias("Cancellation_Frequency"),
        F.count_if(F.col("by_StockCode") & F.col("StockCode").isNotNull()).alias("Unique_Products_Purchased"),
        flag(is_most_frequent("Country", home, "rows", F.col("by_Country"))).alias("Is_UK"),
    )


def customer_counts(lines: DataFrame, home: str) -> DataFrame:
    """What `customer_sets` finds, by one column at a time: for lines dealt by
    customer, since these groups keep them where they are and grouping sets
    don't. What is counted depends on the rows of a group, or else the copies
    would not be dropped first and each count would deal the lines anew."""

    def counted(name: str, **found: Column) -> DataFrame:
        groups = lines.groupBy(KEY, name).agg(F.count(F.lit(1)).alias("rows"))
        return groups.groupBy(KEY).agg(*[column.alias(alias) for alias, column in found.items()])

    some = F.col("rows") > 0
    return (
        counted(
            "InvoiceNo",
            Total_Transactions=F.count_if(some & F.col("InvoiceNo").isNotNull()),
            Cancellation_Frequency=F.count_if(some & is_cancelled()),
        )
        .join(counted("StockCode", Unique_Products_Purchased=F.count_if(some & F.col("StockCode").isNotNull())), KEY)
        .join(counted("Country", Is_UK=flag(is_most_frequent("Country", home, "rows", some))), KEY)
    )


def month_features(lines: DataFrame, first_month: int, last_month: int, dealt: bool = False) -> DataFrame:
    """Mean, deviation and trend of the monthly spend.

    A customer's active months are a bitmap, in as many words as the data has
    spans of `WORD` months. The ordinal of a month is the count of the bits
    below it, and the slope one weighted sum: the squared deviations of the
    ordinals 0..n-1 add up to n(n^2-1)/12. Lines `dealt` by customer need no
    bitmap, as a window over the months of each customer moves nothing.
    """
    timed = lines.withColumn("month", month_number("InvoiceDate") - first_month)
    spent = timed.groupBy(KEY, "month").agg(
        zero_if_null(F.sum(line_spend()).cast("double")).alias("spend"), F.count("InvoiceDate").alias("dates")
    )
    # counted and not filtered beforehand, so that all that reads dealt lines reads the same ones
    spent = spent.where(F.col("dates") > 0).drop("dates")
    if dealt:
        own = Window.partitionBy(KEY)
        ordinal, months = F.row_number().over(own.orderBy("month")) - 1, F.count(F.lit(1)).over(own)
        placed = spent.select(KEY, "spend", ordinal.alias("ordinal"), months.alias("months"))
        ordinal, months = F.col("ordinal"), F.col("months")
    else:
        words = [f"word_{i}" for i in range((last_month - first_month) // WORD + 1)]
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("month") % WORD)
        word = F.floor(F.col("month") / F.lit(WORD))
        active = timed.groupBy(KEY).agg(
            *[F.coalesce(F.bit_or(F.when(word == i, bit)), F.lit(0)).alias(name) for i, name in enumerate(words)]
        )
        placed, ordinal, months = spent.join(active, KEY), F.lit(0), F.lit(0)
        for i, name in enumerate(words):
            below = F.when(word > i, F.bit_count(name)).when(word == i, F.bit_count(F.col(name).bitwiseAND(bit - 1))).otherwise(0)
            ordinal, months = ordinal + below, months + F.bit_count(name)
    weighted = (ordinal - (months - 1) / F.lit(2.0)) * F.col("spend")
    n = F.count(F.lit(1)).cast("double")
    return placed.groupBy(KEY).agg(
        F.avg("spend").alias("Monthly_Spending_Mean"),
        zero_if_null(F.stddev_samp("spend")).alias("Monthly_Spending_Std"),
        F.when(n > 1, F.sum(weighted) * 12 / F.greatest(n * (n * n - 1), F.lit(1.0))).otherwise(0.0).alias("Spending_Trend"),
    )


def line_span(lines: DataFrame) -> tuple:
    """First month, last month and last day of all lines."""
    month = month_number("InvoiceDate")
    return tuple(lines.agg(F.min(month), F.max(month), F.max(F.to_date("InvoiceDate"))).first())


def customer_features(
    lines: DataFrame, settings: Settings = Settings(), span: tuple | None = None, dealt: bool = False
) -> DataFrame:
    """One row for each customer with at least `min_lines` lines.

    Sums run over the lines once; invoices, products, countries and months are
    grouped by the customer and themselves first. All aggregate on the map side
    in buffers of fixed width, so a customer with a third of all lines is spread
    out, and reaches its final task as a row for each map task, and for each of
    its months. The first month and the last day of all lines are read
    beforehand, unless given as `span`. Lines that are `dealt` by customer
    already are not shuffled again.
    """
    first_month, last_month, latest = span or line_span(lines)
    sets = customer_counts if dealt else customer_sets
    customers = (
        customer_sums(lines)
        .where(F.col("lines") >= settings.min_lines)
        .join(sets(lines, settings.home_country), KEY)
        .join(month_features(lines, first_month or 0, last_month or 0, dealt), KEY)
    )
    days = F.datediff("last_day", "first_day")
    features: dict[str, Column] = {
        "Days_Since_Last_Purchase": F.datediff(F.lit(latest), "last_day"),
        "Average_Transaction_Value": ratio("Total_Spend", "Total_Transactions"),
        "Average_Days_Between_Purchases": ratio(days, F.col("lines") - 1),
        "Day_Of_Week": most_counted([F.col(f"weekday_{i}") for i in range(7)]),
        "Hour": most_counted([F.col(f"hour_{i}") for i in range(24)]),
        "Cancellation_Rate": ratio("Cancellation_Frequency", "Total_Transactions"),
    }
    return customers.select(KEY, *[features.get(c, F.col(c)).alias(c) for c in feature_columns(settings.with_rate)])


def deal(lines: DataFrame) -> tuple[DataFrame, DataFrame | None, int]:
    """Stored lines dealt to tasks by customer, which brings copies together as
    well; the lines of customers with a hundredth of all lines or more, which
    are left out of it, or None; the number of tasks."""
    heavy = heavy_keys(lines, KEY)
    tasks = min(lines.count() // DEALT + 1, MOST_TASKS)
    light = lines.where(F.col(KEY).isNotNull() & ~F.col(KEY).isin(heavy)).repartition(tasks, KEY)
    return light, lines.where(F.col(KEY).isin(heavy)) if heavy else None, tasks


def dealt_features(light: DataFrame, heavy: DataFrame | None, settings: Settings, span: tuple) -> DataFrame:
    """`customer_features` of lines that `deal` has dealt, without copies."""
    table = customer_features(light, settings, span, dealt=True)
    return table if heavy is None else table.unionByName(customer_features(heavy, settings, span))


def features_with_copies(lines: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """`customer_features` of stored lines that still hold copies.

    The lines are dealt by customer, so dropping copies and all groups after it
    share this one shuffle. Customers with a hundredth of the lines or more are
    left out of it and spread out instead.
    """
    span = line_span(lines)
    light, heavy, _ = deal(lines)
    return dealt_features(dedupe(light), None if heavy is None else dedupe(heavy), settings, span)
