"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of our own will do on one machine, and is an error on a cluster."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docloom-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A folder that isn't there yet."""
    return f"{shared_dir(spark)}/docloom/{name}-{uuid.uuid4().hex}"


def _of(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _of(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _of(spark, path)
    return fs.exists(p)
