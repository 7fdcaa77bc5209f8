from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from toy import settings

from shelfwise.config import Settings
from shelfwise.functions.aggregates import exact_quantile
from shelfwise.operators import clusters, kmeans, outliers, reduction, scaling
from shelfwise.plans.segmentation import find_outliers


def cloud(spark, n=800, extremes=0, seed=1, partitions=4):
    random = np.random.default_rng(seed)
    pdf = pd.DataFrame(random.normal(size=(n, 4)) * [1, 2, 3, 4], columns=list("abcd"))
    pdf.loc[: extremes - 1, list("abcd")] = 60.0
    pdf.insert(0, "CustomerID", np.arange(n))
    return spark.createDataFrame(pdf).repartition(partitions), pdf


# ---------------------------------------------------------------- outliers


def test_path_lengths():
    assert outliers.expected_path(np.array([0, 1, 2])).tolist() == [0.0, 0.0, 1.0]
    assert float(outliers.expected_path(256)) == pytest.approx(10.2448, abs=1e-3)


def test_tree_covers_its_rows_and_respects_the_limit():
    rows = np.random.default_rng(3).normal(size=(256, 3))
    tree = outliers.grow_tree(rows, "0:7")
    leaves = [i for i, left in enumerate(tree["left"]) if left == i]
    assert len(tree["path"]) == 2 * len(leaves) - 1 <= 511
    same = outliers.grow_tree(np.ones((50, 2)), "0:0")
    assert same["path"] == [pytest.approx(float(outliers.expected_path(50)))]


def test_a_tree_does_not_depend_on_the_order_of_its_rows():
    rows = np.random.default_rng(3).normal(size=(200, 3))
    assert outliers.grow_tree(rows, "0:1") == outliers.grow_tree(rows[::-1], "0:1") != outliers.grow_tree(rows, "0:2")


def test_draws_are_even():
    choices, places = zip(*[outliers.drawn("0:0", node) for node in range(4000)])
    assert abs(np.mean(places) - 0.5) < 0.02 and max(places) < 1
    assert np.bincount(np.array(choices) % 14).std() < 30


def test_planted_extremes_are_flagged(spark):
    df, _ = cloud(spark, n=1000, extremes=5)
    flagged = find_outliers(df, Settings(trees=50)).toPandas()
    assert flagged["Is_Outlier"].sum() == pytest.approx(50, abs=2)
    assert flagged.loc[flagged["CustomerID"] < 5, "Is_Outlier"].tolist() == [1] * 5
    assert set(flagged["Outlier_Scores"]) == {-1, 1}
    assert ((flagged["Outlier_Scores"] == -1) == (flagged["Is_Outlier"] == 1)).all()


def test_scores_do_not_depend_on_the_partitioning(spark):
    scores = []
    for partitions in (1, 8):
        df, _ = cloud(spark, partitions=partitions)
        forest = outliers.fit_isolation_forest(df, list("abcd"), trees=20, tree_rows=64)
        scores.append(forest.score(df).orderBy("CustomerID").toPandas()["score"].tolist())
    assert scores[0] == scores[1]


def test_each_tree_gets_its_full_sample(spark):
    df, _ = cloud(spark, n=3000)
    per_tree = outliers.sample_for_trees(df, list("abcd"), 30, 64, 0).groupBy("tree").agg(
        F.count("*").alias("n"), F.count_distinct("CustomerID").alias("d")
    ).toPandas()
    assert per_tree["n"].tolist() == [64] * 30 == per_tree["d"].tolist()


def test_few_rows_all_go_to_every_tree(spark):
    df, _ = cloud(spark, n=20)
    assert outliers.sample_for_trees(df, list("abcd"), 7, 256, 0).count() == 140
    assert outliers.fit_isolation_forest(df, list("abcd"), trees=7).score(df).count() == 20


def test_missing_features_count_as_zero(spark):
    df, _ = cloud(spark, n=50)
    with_null = df.withColumn("a", F.when(F.col("CustomerID") > 3, F.col("a")))
    zero = with_null.na.fill(0.0)
    forest = outliers.fit_isolation_forest(zero, list("abcd"), trees=5)
    got = [r["score"] for r in forest.score(with_null).orderBy("CustomerID").collect()]
    assert got == [r["score"] for r in forest.score(zero).orderBy("CustomerID").collect()]


@pytest.mark.parametrize("keep", [10, 100_000])
@pytest.mark.parametrize("share", [0.0, 0.37, 0.95, 1.0])
@pytest.mark.parametrize("kind", ["distinct", "third_equal", "two_values", "constant"])
def test_quantile_is_exact(spark, keep, share, kind):
    random = np.random.default_rng(7)
    values = random.normal(size=2001)
    if kind == "third_equal":
        values[:700] = 0.5
    elif kind == "two_values":
        values = np.where(values > 1.6, 2.0, 1.0)
    elif kind == "constant":
        values[:] = 3.0
    df = spark.createDataFrame(pd.DataFrame({"v": values})).repartition(3)
    assert exact_quantile(df, "v", share, keep) == pytest.approx(np.quantile(values, share), abs=1e-12)


def test_quantile_of_nothing(spark):
    empty = spark.createDataFrame([], "score double")
    assert exact_quantile(empty, "score", 0.5) is None
    assert outliers.contamination_threshold(empty) == math.inf


def test_split_is_strict_and_complete(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.6), (3, 0.7)], "CustomerID long, score double")
    inside, outside = outliers.split_outliers(outliers.flag_outliers(df, 0.6))
    assert [tuple(r) for r in inside.collect()] == [(1,), (2,)]
    assert [tuple(r) for r in outside.collect()] == [(3, -1, 1)]


# ---------------------------------------------------------------- scaling and reduction


def test_scaling_uses_the_population_deviation(spark):
    rows = [(1, 1.0, 7.0, 1, 3), (2, 2.0, 7.0, 0, 4), (3, 4.0, 7.0, 0, 5)]
    df = spark.createDataFrame(rows, "CustomerID long, x double, same double, Is_UK int, Day_Of_Week int")
    out = scaling.standardize(df).orderBy("CustomerID").toPandas()
    x = np.array([1.0, 2.0, 4.0])
    assert out["x"].tolist() == pytest.approx(((x - x.mean()) / x.std()).tolist())
    assert out["same"].tolist() == [0.0, 0.0, 0.0]
    assert out["Is_UK"].tolist() == [1, 0, 0] and out["Day_Of_Week"].tolist() == [3, 4, 5]
    assert out.columns.tolist() == df.columns


def test_hour_is_scaled_but_weekday_is_not():
    class Frame:
        columns = ["CustomerID", "Hour", "Day_Of_Week", "Is_UK", "Total_Spend"]

    assert scaling.columns_to_scale(Frame) == ["Hour", "Total_Spend"]


def test_components_match_a_plain_decomposition(spark):
    df, pdf = cloud(spark)
    fitted = reduction.fit_components(df, list("abcd"), 3)
    out = fitted.transform(df).orderBy("CustomerID").toPandas()[["PC1", "PC2", "PC3"]].to_numpy()
    rows = pdf[list("abcd")].to_numpy()
    values, vectors = np.linalg.eigh(np.cov(rows.T))
    vectors = vectors[:, ::-1][:, :3]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(3)])
    assert np.allclose(out, (rows - rows.mean(axis=0)) @ vectors, atol=1e-8)
    assert np.allclose(fitted.loadings.T @ fitted.loadings, np.eye(3), atol=1e-9)
    assert np.allclose(out.mean(axis=0), 0, atol=1e-9)
    assert (np.diff(out.var(axis=0)) <= 0).all()
    assert fitted.explained.tolist() == pytest.approx((values[::-1] / values.sum())[:3].tolist())
    assert sum(reduction.explained_variance(df, list("abcd"))) == pytest.approx(1.0)


def test_covariance(spark):
    df, pdf = cloud(spark, n=100)
    found = {(r[0], r[1]): r[2] for r in reduction.covariance(df, list("abcd")).collect()}
    expected = np.cov(pdf[list("abcd")].to_numpy().T, ddof=0)
    assert len(found) == 10
    for (a, b), value in found.items():
        assert value == pytest.approx(expected["abcd".index(a), "abcd".index(b)])


# ---------------------------------------------------------------- clusters


@pytest.fixture(scope="module")
def blobs(spark):
    random = np.random.default_rng(2)
    centres = np.repeat([[0, 0], [8, 0], [0, 8]], [60, 30, 110], axis=0)
    pdf = pd.DataFrame(centres + random.normal(size=(200, 2)), columns=["PC1", "PC2"])
    pdf.insert(0, "CustomerID", range(200))
    return spark.createDataFrame(pdf).repartition(3).cache(), pdf


def test_kmeans_finds_the_blobs(spark, blobs):
    df, pdf = blobs
    centroids, costs = clusters.fit_centroids(df, ["PC1", "PC2"], starts=5)
    assert len(costs) == 5 and centroids == sorted(centroids)
    rows = pdf[["PC1", "PC2"]].to_numpy()
    squared = ((rows[:, None, :] - np.array(centroids)[None]) ** 2).sum(axis=2)
    assert squared.min(axis=1).sum() == pytest.approx(min(costs), rel=1e-6)
    assigned = clusters.assign(df, ["PC1", "PC2"], centroids)
    labels = assigned.orderBy("CustomerID").toPandas()["cluster"].to_numpy()
    assert (labels == squared.argmin(axis=1)).all()
    named = clusters.relabel(assigned)
    sizes = {r["cluster"]: r["Customers"] for r in clusters.cluster_sizes(named).collect()}
    assert sizes == {0: 110, 1: 60, 2: 30}


def test_labels(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate([2, 2, 2, 0, 1])], "CustomerID long, cluster int")
    assert clusters.frequency_labels(df) == {2: 0, 0: 1, 1: 2}  # the tie keeps its order
    fixed = clusters.relabel(df, {0: 1, 1: 2, 2: 0})
    assert [r["cluster"] for r in fixed.orderBy("CustomerID").collect()] == [0, 0, 0, 1, 2]


def test_first_centroid_wins_a_tie(spark):
    df = spark.createDataFrame([(1, 0.0)], "CustomerID long, x double")
    assert clusters.assign(df, ["x"], [[1.0], [-1.0]]).first()["cluster"] == 0


def test_quality_measures(spark, blobs):
    df, pdf = blobs
    labelled = df.withColumn("cluster", (F.col("CustomerID") >= 60).cast("int") + (F.col("CustomerID") >= 90).cast("int"))
    rows = pdf[["PC1", "PC2"]].to_numpy()
    labels = np.repeat([0, 1, 2], [60, 30, 110])
    centres = np.array([rows[labels == c].mean(axis=0) for c in range(3)])
    within = sum(((rows[labels == c] - centres[c]) ** 2).sum() for c in range(3))
    total = ((rows - rows.mean(axis=0)) ** 2).sum()
    radius = [np.sqrt(((rows[labels == c] - centres[c]) ** 2).sum(axis=1)).mean() for c in range(3)]
    worst = [
        max((radius[i] + radius[j]) / np.linalg.norm(centres[i] - centres[j]) for j in range(3) if j != i)
        for i in range(3)
    ]
    row = clusters.cluster_quality(labelled, ["PC1", "PC2"]).first()
    assert row["calinski_harabasz"] == pytest.approx(((total - within) / 2) / (within / 197))
    assert row["davies_bouldin"] == pytest.approx(np.mean(worst))
    assert 0.7 < clusters.silhouette(labelled, ["PC1", "PC2"]) <= 1.0
    costs = [cost for _, cost in clusters.cost_by_k(df, ["PC1", "PC2"], range(2, 5), starts=3)]
    assert costs == sorted(costs, reverse=True)


def test_clusters_are_appended_by_customer(spark):
    customers = spark.createDataFrame([(1, "x"), (2, "y")], "CustomerID long, v string")
    assigned = spark.createDataFrame([(2, 0), (1, 1)], "CustomerID long, cluster int")
    rows = clusters.append_cluster(customers, assigned).orderBy("CustomerID").collect()
    assert [tuple(r) for r in rows] == [(1, "x", 1), (2, "y", 0)]


def test_scoring_does_not_need_the_package_on_executors(spark):
    from pyspark import cloudpickle

    source = cloudpickle.dumps(outliers.score_rows)
    assert b"grow_tree" not in source and b"column_stack" not in source
    assert b"power" in source  # the code itself, not a reference to the module


def test_settings_are_restored(spark):
    with settings(spark, {"spark.sql.adaptive.enabled": "false"}):
        pass
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_clusters_do_not_depend_on_the_partitioning(spark, monkeypatch):
    """Equal to the last bit, whatever the partitions of the points and of the passes."""
    rng = np.random.default_rng(4)
    rows = [(i, *map(float, rng.normal(3 * (i % 3), 1.0, 2))) for i in range(600)]
    found = set()
    for partitions, rows_a_task in ((1, 4096), (8, 4096), (8, 50), (64, 10)):
        monkeypatch.setattr(kmeans, "ROWS_A_TASK", rows_a_task)
        df = spark.createDataFrame(rows, "CustomerID long, PC1 double, PC2 double").repartition(partitions)
        centroids, costs = clusters.fit_centroids(df, ["PC1", "PC2"], starts=3)
        labels = clusters.assign(df, ["PC1", "PC2"], centroids).orderBy("CustomerID").collect()
        found.add((str(centroids), str(costs), tuple(r["cluster"] for r in labels)))
    assert len(found) == 1


def test_steps_equal_plain_ones(spark, blobs):
    """All starts move as each would alone, in shared passes."""
    df, pdf = blobs
    rows = pdf[["PC1", "PC2"]].to_numpy()
    points = kmeans.prepared(df, ["PC1", "PC2"], 0)
    begun = kmeans.starting_centroids(points, 4, 6, 0)
    tolerance = kmeans.TOLERANCE * kmeans.mean_variance(points)
    assert tolerance == pytest.approx(1e-4 * rows.var(axis=0).mean())
    ended = kmeans.lloyd(points, begun, 100, tolerance)
    for start, end in zip(begun, ended, strict=True):
        for _ in range(100):
            nearest = ((rows[:, None, :] - start[None]) ** 2).sum(axis=2).argmin(axis=1)
            moved = np.array([rows[nearest == c].mean(axis=0) if (nearest == c).any() else start[c] for c in range(4)])
            start, before = moved, start
            if ((start - before) ** 2).sum() <= tolerance:
                break
        assert end == pytest.approx(start, abs=1e-9)
    points.df.unpersist()


def test_passes_are_shared(spark, blobs, monkeypatch):
    df, _ = blobs
    passes = []
    summed = kmeans.Points.summed
    monkeypatch.setattr(kmeans.Points, "summed", lambda self, measure: passes.append(1) or summed(self, measure))
    clusters.fit_centroids(df, ["PC1", "PC2"], k=4, starts=10, max_iterations=20)
    assert len(passes) <= 20 + 9


def test_starts_reach_the_cost_of_the_library(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    df, _ = cloud(spark, n=1500, seed=6)
    vectors = VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(df)
    best = min(KMeans(k=5, maxIter=100, seed=s).fit(vectors).summary.trainingCost for s in range(5))
    _, costs = clusters.fit_centroids(df, list("abcd"), k=5)
    assert min(costs) <= best * 1.01


def test_clusters_of_few_and_equal_points(spark):
    schema = "CustomerID long, x double"
    centroids, costs = clusters.fit_centroids(spark.createDataFrame([(1, 2.0), (2, 2.0)], schema), ["x"], starts=2)
    assert centroids == [[2.0]] * 3 and costs == [0.0, 0.0]
    with pytest.raises(ValueError, match="no points"):
        clusters.fit_centroids(spark.createDataFrame([], schema), ["x"])
    far = spark.createDataFrame([(i, 1e12 + i % 2 * 1e9) for i in range(10)], schema)
    assert np.ravel(clusters.fit_centroids(far, ["x"], k=2, starts=3)[0]) == pytest.approx([1e12, 1.001e12])


def test_silhouette_equals_all_pairs(spark):
    random = np.random.default_rng(8)
    rows = random.normal(size=(80, 2)) * 3
    labels = np.array([0] * 50 + [1] * 29 + [5])
    df = spark.createDataFrame([(int(c), *map(float, r)) for c, r in zip(labels, rows, strict=True)], "cluster int, x double, y double")
    squared = ((rows[:, None] - rows[None]) ** 2).sum(axis=2)
    values = []
    for i, label in enumerate(labels):
        own = labels == label
        if own.sum() == 1:
            values.append(0.0)
            continue
        a = squared[i, own].sum() / (own.sum() - 1)
        b = min(squared[i, labels == c].mean() for c in set(labels) - {label})
        values.append((b - a) / max(a, b))
    assert clusters.silhouette(df, ["x", "y"]) == pytest.approx(np.mean(values), abs=1e-9)
    assert clusters.silhouette(df.where("cluster = 0"), ["x", "y"]) is None
    assert clusters.silhouette(df.where("cluster > 9"), ["x", "y"]) is None


def test_a_map_without_a_cluster_raises(spark):
    df = spark.createDataFrame([(i, i % 4) for i in range(8)], "CustomerID long, cluster int")
    with pytest.raises(ValueError, match="3"):
        clusters.relabel(df, {0: 1, 1: 2, 2: 0})
