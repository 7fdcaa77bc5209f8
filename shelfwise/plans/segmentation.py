"""The whole computation, from invoice lines to recommendations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from shelfwise.config import Settings
from shelfwise.operators.cleaning import clean
from shelfwise.operators.clusters import append_cluster, assign, fit_centroids, relabel
from shelfwise.operators.features import customer_features, feature_columns
from shelfwise.operators.outliers import (
    contamination_threshold,
    fit_isolation_forest,
    flag_outliers,
    split_outliers,
)
from shelfwise.operators.recommend import recommend
from shelfwise.operators.reduction import fit_components
from shelfwise.operators.scaling import columns_to_scale, standardize
from shelfwise.session import cut_lineage, store


@dataclass(frozen=True)
class Segmentation:
    lines: DataFrame  # cleaned
    features: DataFrame  # every customer with features
    outliers: DataFrame
    scaled: DataFrame
    components: DataFrame  # PC1.. and cluster
    customers: DataFrame  # inliers with cluster


def find_outliers(features: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Features with Outlier_Scores and Is_Outlier, stored with their scores so
    that neither is computed again for the threshold or the split."""
    columns = [c for c in features.columns if c != "CustomerID"]
    forest = fit_isolation_forest(features, columns, settings.trees, settings.tree_rows, settings.seed)
    scored = cut_lineage(forest.score(features))
    return flag_outliers(scored, contamination_threshold(scored, settings.contamination))


def segment(lines: DataFrame, settings: Settings = Settings()) -> Segmentation:
    """Clean lines, derive features, set outliers apart and cluster the rest.

    The cleaned lines are read several times, here and by the recommender, so
    they are stored: the source is parsed and its copies dropped only once.
    """
    columns = feature_columns(settings.with_rate)
    cleaned = store(clean(lines, settings), "lines")
    features = cut_lineage(customer_features(cleaned, settings))
    inliers, outliers = split_outliers(find_outliers(features, settings))
    scaled = standardize(inliers, columns_to_scale(inliers))
    reduced = fit_components(scaled, columns, settings.components).transform(scaled)
    axes = [c for c in reduced.columns if c != "CustomerID"]
    centroids, _ = fit_centroids(
        reduced,
        axes,
        settings.clusters,
        settings.starts,
        settings.max_iterations,
        settings.seed,
    )
    components = cut_lineage(relabel(assign(reduced, axes, centroids), settings.label_map))
    return Segmentation(
        lines=cleaned,
        features=features,
        outliers=outliers,
        scaled=scaled,
        components=components,
        customers=append_cluster(inliers, components),
    )


def run(lines: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Every inlier with features, cluster and recommended products."""
    result = segment(lines, settings)
    customers = cut_lineage(result.customers)
    return recommend(
        result.lines, customers, top_n=settings.top_products, k=settings.recommendations
    )
