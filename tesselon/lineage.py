"""Lineage cuts and the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster names it in ``spark.checkpoint.dir``; only where that is unset, as in local tests,
    a new temporary folder is taken. On a cluster that would be another disk on every machine, so there
    the setting must be made.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not (sc.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="tesselon-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more, wherever it is stored."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame, instead: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it again.

    For loops this is better than a checkpoint: a checkpointed plan keeps the size that was estimated
    for it, and as the estimate of a join is a product, it would grow without bound from round to
    round. A table has the size of its files. They are written plainly, without dictionaries and
    compression: else millions of rows with repeated keys look small enough for a broadcast. ``instead`` is the table of an earlier round that nothing
    reads any more once this one is written; it is deleted.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)
    if instead is not None and (old := getattr(instead, "_cut", None)):
        remove(spark, old)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut = path
    return out
