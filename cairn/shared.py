"""The folder that driver and executors share, and frames that are written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. A local session that names none (as in tests) gets a temporary
    folder; on a cluster that would lose rows, so it is an error there."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='cairn-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system and path object for ``path``."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def staged(df: DataFrame, *done: DataFrame, parts: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage so that a lost executor costs no recomputation, and drops
    the partitioning, so that a later join shuffles both sides and Spark can
    split its hot keys. Frames in ``done`` (of this function) are needed no more
    and their files go now; all others go when the driver ends. ``parts`` names a column of
    few values by which the files are parted, so that a filter on it leaves the others unread.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cairn-{uuid.uuid4().hex}"
    if parts:
        df.hint("rebalance", parts).write.partitionBy(parts).parquet(path)
    else:
        df.write.parquet(path)
    files, where = file_system(spark, path)
    files.deleteOnExit(where)
    discard(*done)
    back = spark.read.schema(df.schema).parquet(path)
    back._cairn_path = path
    return back


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames that ``staged`` made, or that are made of such frames and say so in ``_cairn_parts``."""
    for old in frames:
        for part in getattr(old, "_cairn_parts", [old]):
            files, where = file_system(part.sparkSession, part._cairn_path)
            files.delete(where, True)
            files.cancelDeleteOnExit(where)
