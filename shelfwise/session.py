"""Session defaults and the shared folder that long lineages are cut into."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "shelfwise") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    partitions = "8" if cores == "*" else str(cores)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.codegen.cache.maxEntries", "2000")  # the steps repeat; do not compile them again
        # the place in the source of each column expression costs more than building it
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# what store() has made inside each open dropping_stored(): paths, or frames held by this session
_made: list[list[str | DataFrame]] = []
#: With this setting of Spark, what a query has shuffled goes when the query ends and not when the driver collects garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configured_folder(spark: SparkSession) -> str | None:
    """The folder every executor can reach, as the session names it."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def shared_folder(spark: SparkSession) -> str:
    """That folder, or in a local session its warehouse."""
    folder = configured_folder(spark)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/shelfwise"
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """What the writes inside shuffle is dropped once they are done, as nothing reads it again."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


def store(df: DataFrame, name: str = "table", buckets: tuple[int, str] | None = None) -> DataFrame:
    """Write a result as a columnar table in the shared folder, for steps that
    each read a few of its columns; a lost executor then costs a re-read
    instead of all the work before it. A local session without such a folder
    holds the rows itself.

    Rows that are dealt by a column already, `repartition(*buckets)`, are stored
    so that Spark still knows: groups and joins by that column read them in place."""
    spark = df.sparkSession
    if not configured_folder(spark) and spark.sparkContext.master.startswith("local"):
        made: str | DataFrame = df.persist(StorageLevel.MEMORY_AND_DISK)
        made.count()
        out = made
    else:
        made = new_path(spark, name)
        with _dropping_shuffles(spark):
            if buckets is None:
                df.write.parquet(made)
            else:
                # Spark writes buckets to a table with a name only; without it the files stay, and what reads them
                named = f"spark_catalog.default.{made.rpartition('/')[2].replace('-', '_')}"
                number, key = buckets
                df.write.format("parquet").option("path", made).bucketBy(number, key).sortBy(key).saveAsTable(named)
        if buckets is None:
            out = spark.read.schema(df.schema).parquet(made)
        else:
            out = spark.table(named)
            spark.sql(f"drop table {named}")
    if _made:
        _made[-1].append(made)
    return out


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store a customer-grain result."""
    return store(df, "customers")


@contextmanager
def dropping_stored(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Drops what was stored inside, once the results that need it are written.
    What was stored last stays if it is handed to the function that this gives."""
    _made.append([])

    def keep(stored: DataFrame) -> DataFrame:
        made = _made[-1].pop()
        if len(_made) > 1:
            _made[-2].append(made)
        return stored

    try:
        yield keep
    finally:
        for made in _made.pop():
            if isinstance(made, str):
                path = spark._jvm.org.apache.hadoop.fs.Path(made)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            else:
                made.unpersist()
