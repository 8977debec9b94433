"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder from spark.checkpoint.dir; only in local mode without that setting a temporary one is made, which goes with the process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("pixelgrove.scratch.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder shared by driver and executors")
        folder = tempfile.mkdtemp(prefix="pixelgrove-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = f"file://{folder}"
        spark.conf.set("pixelgrove.scratch.dir", found)
    return found.rstrip("/")


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/pixelgrove/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below this application's part of the shared folder."""
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> bool:
    """Deletes all intermediate tables of this application; results that are not written yet can't be read after it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own(spark))
    return bool(path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True))


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts the lineage and outlives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
