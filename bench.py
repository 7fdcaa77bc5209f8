"""Headline timings: one JSON line. Median of three runs after a warm-up."""

from __future__ import annotations

import json
import os
import statistics
import time
from collections.abc import Callable

from shelfwise.config import Settings
from shelfwise.operators import clusters, features, outliers, recommend, reduction, scaling
from shelfwise.operators.cleaning import clean
from shelfwise.plans.segmentation import run
from shelfwise.session import cut_lineage, local_session, store
from shelfwise.sources.retail_view import VIEW_SETTINGS, market_segments, retail_lines

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CORES = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def materialize(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action: Callable[[], object]) -> float:
    action()
    times = []
    for _ in range(RUNS):
        start = time.perf_counter()
        action()
        times.append(time.perf_counter() - start)
    return round(statistics.median(times), 3)


def main() -> None:
    spark = local_session(CORES, "bench")
    settings: Settings = VIEW_SETTINGS

    # inputs of the single steps, stored outside the timings
    raw = store(retail_lines(spark, FOLDER), "raw")
    lines = store(clean(raw, settings), "lines")
    table = cut_lineage(features.customer_features(lines, settings))
    columns = [c for c in table.columns if c != "CustomerID"]
    forest = outliers.fit_isolation_forest(table, columns)
    scored = cut_lineage(forest.score(table))
    scaled = cut_lineage(scaling.standardize(table))
    reduced = cut_lineage(reduction.fit_components(scaled, columns).transform(scaled))
    axes = [c for c in reduced.columns if c != "CustomerID"]
    segments = cut_lineage(table.join(market_segments(spark, FOLDER), "CustomerID"))

    steps: dict[str, Callable[[], object]] = {
        "clean": lambda: materialize(clean(raw, settings)),
        "customer_features": lambda: materialize(features.customer_features(lines, settings)),
        "isolation_forest_fit": lambda: outliers.fit_isolation_forest(table, columns),
        "isolation_forest_score": lambda: materialize(forest.score(table)),
        "contamination_threshold": lambda: outliers.contamination_threshold(scored),
        "standardize": lambda: materialize(scaling.standardize(table)),
        "pca": lambda: materialize(reduction.fit_components(scaled, columns).transform(scaled)),
        "kmeans": lambda: clusters.fit_centroids(reduced, axes),
        "best_sellers": lambda: materialize(
            recommend.top_products(recommend.best_sellers(lines, segments))
        ),
        "recommend": lambda: materialize(recommend.recommend(lines, segments)),
        "full_run": lambda: materialize(run(raw, settings)),
    }
    times = {name: timed(step) for name, step in steps.items()}
    print(
        json.dumps(
            {
                "metric": "sum of median step times, without the full run that repeats them",
                "value": round(sum(t for name, t in times.items() if name != "full_run"), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
                "cores": int(CORES),
            }
        )
    )


if __name__ == "__main__":
    main()
