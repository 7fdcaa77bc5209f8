"""Input tables, and intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of an input table, so that scans read nothing else."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a session whose executors live in this process may go without
    the setting; it then takes one in its warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/llm"
    return folder


_made: list[list[str]] = []  # what stored() has written inside each open dropping_stored()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Write `df` as a table and read it again; the table stays."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same for a step on the way: what comes after neither repeats the work nor depends on the executors that did
    it. An open dropping_stored() deletes the table at its end."""
    path = new_path(df.sparkSession, name)
    if _made:
        _made[-1].append(path)
    return written(df, path)


@contextmanager
def dropping_stored(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables of the steps inside, once the results that need them are written."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
