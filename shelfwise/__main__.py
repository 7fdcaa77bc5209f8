"""From a CSV file of invoice lines to a folder of recommendations.

    python -m shelfwise lines.csv recommendations
    spark-submit --py-files shelfwise.zip shelfwise/__main__.py lines.csv recommendations
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from shelfwise.config import Settings
from shelfwise.plans.segmentation import run, segment
from shelfwise.session import cut_lineage, dropping_stored
from shelfwise.sources.transactions import DATE_PATTERN, preview, read_transactions, write_recommendations


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="shelfwise", description=__doc__.splitlines()[0])
    parser.add_argument("lines", help="CSV with a header, one row per invoice line")
    parser.add_argument("output", nargs="?", help="folder for the result; without it only the segments are shown")
    parser.add_argument("--date-pattern", action="append", help="may be given several times; the first that fits counts")
    parser.add_argument("--multi-line", action="store_true", help="quoted fields may hold line breaks")
    parser.add_argument("--with-rate", action="store_true", help="include the cancellation rate")
    options = parser.parse_args(arguments)

    spark = SparkSession.builder.appName("shelfwise").getOrCreate()
    settings = Settings(with_rate=options.with_rate)
    lines = read_transactions(
        spark, options.lines, date_pattern=options.date_pattern or DATE_PATTERN, multi_line=options.multi_line
    )
    with dropping_stored(spark):
        if options.output is None:
            preview(segment(lines, settings).customers).show()
            return
        result = cut_lineage(run(lines, settings))
        preview(result).show()
        write_recommendations(result, options.output)


if __name__ == "__main__":
    main()
