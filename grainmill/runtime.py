"""Session helpers: table access, staged results in the shared folder, guarded broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast once its size was counted.
BROADCAST_ROWS = 10_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table `name` of a data folder; timestamps come as TIMESTAMP_NTZ."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    The cluster names it in spark.checkpoint.dir. Only where that is unset, as in local
    tests, a folder of this machine is made and set.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    made = tempfile.mkdtemp(prefix="grainmill-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(made)
    return jsc.getCheckpointDir().get().rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path among the staged tables of this application."""
    return f"{staged_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged_dir(spark: SparkSession) -> str:
    """Where this application stages its tables."""
    return f"{shared_dir(spark)}/grainmill/{spark.sparkContext.applicationId}"


def clear_staged(spark: SparkSession) -> None:
    """Remove all tables that this application staged; to be called once its results are written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(staged_dir(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a result to the shared folder and read it back.

    The lineage ends there, so a lost executor costs only its running tasks. The tables lie under
    one folder per application, which clear_staged removes.
    """
    spark, path = df.sparkSession, stage_path(df.sparkSession, name)
    schema = df.schema
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(schema).parquet(path)


def few(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether a table holds at most `most` rows; reads no more than most + 1 of them."""
    return df.limit(most + 1).count() <= most


def broadcast_if_few(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a side for broadcast after counting that it is small; else leave it to the planner."""
    return F.broadcast(df) if few(df, most) else df
