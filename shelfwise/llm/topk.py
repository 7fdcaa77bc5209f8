"""Exact top-k search: histograms of all scores locate each query's kth score, then what reaches it is taken."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.storage import stored

BLOCK = 4096  # candidates in a block, about
QUERIES = 1024  # queries in a group
BINS = 256


def quantized(vectors: DataFrame, id_column: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, x): floor(scale * component) as integers. Vectors that are null, empty of meaning (a null or non-finite
    component) or without id take no part; rows that repeat an id and a vector count once."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.col(id_column).isNotNull() & F.col(vector).isNotNull() & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    )
    whole = F.transform(x, lambda v: F.floor(v * scale).cast("double"))
    rows = vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_column).cast("long").alias("vec_id"), whole.alias("x"))
    return rows.distinct()


def _matrix(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [np.asarray(v, np.float64) for v in column.to_pylist()]


def _scores(table: pa.Table) -> tuple[list[dict], np.ndarray, np.ndarray]:
    """Queries, candidates' ids and scores of a cell; -inf marks a query's own row and other dimensions. Doubles hold
    integer sums up to 2^53 exactly."""
    ids = table.column("vec_id").to_numpy()
    kinds = table.column("is_query").to_numpy(zero_copy_only=False)
    vectors = _matrix(table.column("x"))
    size = max((len(v) for v in vectors), default=0)
    matrix = np.zeros((len(vectors), size))
    for i, v in enumerate(vectors):  # shorter ones are filled up
        matrix[i, : len(v)] = v
    lengths = np.array([len(v) for v in vectors])
    q, c = np.flatnonzero(kinds), np.flatnonzero(~kinds)
    scores = matrix[q] @ matrix[c].T
    scores[(ids[q][:, None] == ids[c][None, :]) | (lengths[q][:, None] != lengths[c][None, :])] = -np.inf
    low, width, rest = (table.column(n).to_numpy()[q] for n in ("low", "width", "rest"))
    queries = [{"id": i, "low": a, "width": w, "rest": r} for i, a, w, r in zip(ids[q], low, width, rest, strict=True)]
    return queries, ids[c], scores


def _cells(candidates: DataFrame, queries: DataFrame, blocks: int, groups: int) -> DataFrame:
    """Candidates in blocks and queries in groups, each block with each group: a cell holds a bounded number of rows."""
    own = candidates.select(
        F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>")).alias("group"),
        F.lit(False).alias("is_query"), "vec_id", "x",
        F.lit(0.0).alias("low"), F.lit(0.0).alias("width"), F.lit(0).cast("long").alias("rest"),
    )
    asked = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")).alias("block"),
        F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).alias("group"),
        F.lit(True).alias("is_query"), "vec_id", "x", "low", "width", "rest",
    )
    return own.union(asked).groupBy("block", "group")


def _counts(table: pa.Table) -> pa.Table:
    """Of each query's range of scores [low, low + BINS * width), the counts by bin: from the top on only as many bins
    as it takes to reach the rest, since the kth is in none below."""
    queries, _, scores = _scores(table)
    out = []
    for q, row in zip(queries, scores, strict=True):
        bins = np.floor((row[np.isfinite(row)] - q["low"]) / q["width"])
        bins = bins[(bins >= 0) & (bins < BINS)].astype(np.int64)
        counts = np.bincount(bins, minlength=BINS)
        above = np.cumsum(counts[::-1])[::-1]
        enough = np.flatnonzero(above >= q["rest"])
        counts[: enough[-1] if len(enough) else 0] = 0
        out += [(q["id"], int(b), int(counts[b])) for b in np.flatnonzero(counts)]
    columns = zip(*out, strict=True) if out else ((), (), ())
    return pa.table(
        [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64()), strict=True)],
        names=["query_id", "bin", "n"],
    )


def _reaching(k: int):
    def take(table: pa.Table) -> pa.Table:
        """A cell's scores that reach the query's kth, at most k of them: ties go to the smaller id, here as later."""
        queries, ids, scores = _scores(table)
        out = []
        for q, row in zip(queries, scores, strict=True):
            hits = np.flatnonzero(np.isfinite(row) & (row >= q["low"]))
            best = hits[np.lexsort((ids[hits], -row[hits]))[:k]]
            out += [(q["id"], int(ids[i]), int(row[i])) for i in best]
        columns = zip(*out, strict=True) if out else ((), (), ())
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return take


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 20, id_column: str = "vec_id", vector: str = "embedding",
    scale: int = 64,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k highest integer inner products with the vectors of other
    ids, ties to the smaller id; all, if there are fewer.

    Each round scores everything in cells of a block of candidates and a group of queries, and sums histograms over the
    blocks: first over the range that lengths of vectors allow, then over the bin that holds the kth score, until that
    bin is one score wide. Then what reaches the kth score is taken. Only numbers about the whole table come to the
    driver. An empty table gives an empty one.
    """
    candidates = stored(quantized(vectors, id_column, vector, scale), "vectors")
    asked = quantized(queries, id_column, vector, scale)
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    n, longest = candidates.agg(F.count(F.lit(1)), F.max(norm)).first()
    blocks = max(1, -(-n // BLOCK))
    # no score is larger than the product of the lengths; one more on either side for rounding
    width = 1
    while BINS * width < 2 * ((longest or 0.0) ** 2 + 2) + 1:
        width *= BINS
    asked = stored(
        asked.select(
            "vec_id", "x", (-F.ceil(norm * (longest or 0.0)) - 1).cast("double").alias("low"),
            F.lit(float(width)).alias("width"), F.lit(k).cast("long").alias("rest"),
        ),
        "queries",
    )
    groups = max(1, -(-asked.count() // QUERIES))
    while width:
        cells = _cells(candidates, asked, blocks, groups)
        counts = cells.applyInArrow(_counts, "query_id long, bin int, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        bins = counts.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("bin", "n")), False).alias("bins"))
        located = asked.join(bins, asked["vec_id"] == bins["query_id"], "left").withColumn(
            "at",
            F.aggregate(
                F.coalesce("bins", F.array().cast("array<struct<bin:int,n:bigint>>")),
                F.struct(F.col("rest").alias("rest"), F.lit(0).alias("bin"), F.lit(False).alias("found")),
                lambda a, b: F.when(a["found"], a).otherwise(
                    F.struct(
                        F.when(b["n"] >= a["rest"], a["rest"]).otherwise(a["rest"] - b["n"]).alias("rest"),
                        b["bin"].alias("bin"),
                        (b["n"] >= a["rest"]).alias("found"),
                    )
                ),
            ),
        )
        # without a kth, all scores are taken: the range stays as it is from the bottom
        found = F.col("at.found")
        asked = stored(
            located.select(
                "vec_id", "x",
                F.when(found, F.col("low") + F.col("at.bin") * F.col("width")).otherwise(F.col("low")).alias("low"),
                (F.col("width") / BINS).alias("width"),
                F.when(found, F.col("at.rest")).otherwise(F.col("rest")).alias("rest"),
            ),
            "queries",
        )
        width //= BINS
    reaching = _cells(candidates, asked, blocks, groups).applyInArrow(
        _reaching(k), "query_id long, vec_id long, score long"
    )
    best = reaching.groupBy("query_id").agg(
        F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best")
    )
    return best.select("query_id", F.posexplode("best").alias("place", "b")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"),
        (-F.col("b.s")).alias("score"),
    )
