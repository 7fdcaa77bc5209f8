"""Parameters of the whole computation, with the values of a standard run."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

# Texts that older data sources write for a missing value.
NULL_MARKERS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Descriptions of services rather than goods, exact case.
SERVICE_NAMES = ("Next Day Carriage", "High Resolution Image")


@dataclass(frozen=True)
class Settings:
    # cleaning
    max_code_digits: int = 1
    service_names: tuple[str, ...] = SERVICE_NAMES
    # features
    home_country: str = "United Kingdom"
    min_lines: int = 2
    with_rate: bool = False
    # outliers
    contamination: float = 0.05
    trees: int = 100
    tree_rows: int = 256
    # reduction and clusters
    components: int = 6
    clusters: int = 3
    starts: int = 10
    max_iterations: int = 100
    label_map: Mapping[int, int] | None = None  # None: the largest cluster becomes 0
    # recommendations
    top_products: int = 10
    recommendations: int = 3
    seed: int = 0
