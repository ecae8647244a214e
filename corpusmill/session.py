"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Read the Parquet table `name` below `base`."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; unset, a local session takes one of its own and any other is an error."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + os.path.join(tempfile.gettempdir(), f"corpusmill-{os.getpid()}")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def settle(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage of `df` with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager)


def spread(df: DataFrame) -> DataFrame:
    """Give every core a part if the input has fewer splits than there are cores; larger inputs stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def texts(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A table of texts, of which each row costs much work."""
    return spread(table(spark, base, name))
