"""Session settings, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

#: Rows one window partition may hold before the spread form takes over.
#: 2 million narrow rows sort comfortably inside one executor core's share.
DEFAULT_WINDOW_ROWS = 2_000_000
WINDOW_ROWS_CONF = "spark.tallyloom.windowRows"

#: Rows a table may hold to be sent to every executor.
DEFAULT_BROADCAST_ROWS = 200_000
BROADCAST_ROWS_CONF = "spark.tallyloom.broadcastRows"


def local_session(cores: str = "8", app: str = "tallyloom") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def window_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(WINDOW_ROWS_CONF, str(DEFAULT_WINDOW_ROWS)))


def broadcast_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_ROWS_CONF, str(DEFAULT_BROADCAST_ROWS)))


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below the one the session names in
    ``spark.checkpoint.dir``; a folder is chosen here only where none is named
    and driver and executors are one process, as in unit tests.  Anywhere else
    a folder of this machine would lose the rows of the others."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    It cuts the lineage, survives lost executors, and later passes read only
    the columns they need.  (An eager ``checkpoint()`` would run the last stage
    twice, once to count and once to write.)
    """
    spark = df.sparkSession
    path = new_table(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_table(spark: SparkSession) -> str:
    """Path of a table that is not there yet, in the shared folder."""
    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


def add(part: DataFrame, path: str) -> DataFrame:
    """Write ``part`` beside what the table at ``path`` holds, and read all of it."""
    part.write.mode("append").option("compression", "zstd").parquet(path)
    return part.sparkSession.read.schema(part.schema).parquet(path)


def cut_all(parts: Iterable[DataFrame]) -> DataFrame:
    """One written table of tables with the same columns; each is written before the next is asked for."""
    path, first = None, None
    for part in parts:
        path = path or new_table(part.sparkSession)
        part.write.mode("append").option("compression", "zstd").parquet(path)
        first = first or part
    if first is None:
        raise ValueError("no table to write")
    return first.sparkSession.read.schema(first.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-spread rows over the cores when the scan yields fewer partitions.

    For work that costs far more than a shuffle of its input (text search over
    a few large row groups); a scan that is already split stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
