"""The folder that driver and executors share."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlsplit
from urllib.request import url2pathname

from pyspark.sql import DataFrame, SparkSession

DEFAULT_WORK_DIR = "file:///tmp/checkpoints/tessera"


def work_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session that names none gets a local one, a cluster's must name it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = DEFAULT_WORK_DIR
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def shared_file(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for files that tasks write at given places.

    Needs a shared folder that is mounted as a file system.
    """
    url = urlsplit(work_dir(spark))
    if url.scheme not in ("", "file"):
        raise ValueError("Raster files need a shared folder that is mounted")
    folder = url2pathname(url.path) if url.scheme else work_dir(spark)
    os.makedirs(folder, exist_ok=True)
    return os.path.join(folder, f"{uuid.uuid4().hex}-{name}")


def at_exit(spark: SparkSession, path: str) -> None:
    """Remove a file or folder when the driver's JVM ends."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or folder, if it is there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder of files in the shared folder, which goes when the driver's JVM ends."""
    folder = shared_file(spark, name)
    os.makedirs(folder)
    at_exit(spark, f"file://{folder}")
    return folder


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, computed once; it goes when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)
