"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which the cluster names in spark.checkpoint.dir. Only a session on one machine may do without and gets /tmp/checkpoints."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fresh(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, whose files go when the JVM ends."""
    path = f"{shared_dir(spark)}/glyphflow/{label}-{uuid.uuid4().hex}"
    where, files = _folder(spark, path)
    files.deleteOnExit(where)
    return path


def materialise(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, so that a lost
    executor costs a read and not the lineage. The files go by ``release``, else when the JVM ends."""
    spark = df.sparkSession
    path = fresh(spark, label)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more."""
    where, files = _folder(df.sparkSession, df.stored_at)
    files.delete(where, True)


def sweep(spark: SparkSession) -> None:
    """Delete the shuffle files of plans that nothing holds any more; the engine does so whenever the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
