"""Tables that cut lineage, in the folder that the whole cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULT = "/tmp/tidewalk-scratch"


def scratch_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a session on a single machine without that setting gets a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (found or LOCAL_DEFAULT).rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    """This application's folder; it goes when the application ends."""
    path = f"{scratch_dir(spark)}/tidewalk/{spark.sparkContext.applicationId}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        files.mkdirs(folder)
        files.deleteOnExit(folder)
    return path


def cut(df: DataFrame, name: str = "table", options: dict | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: a lost executor costs no recomputation of what lies before.

    options: of the writer; a smaller ``parquet.block.size`` lets a task hold less of wide rows. The tables stay until the application ends or ``clear_scratch`` removes them.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Remove all tables that ``cut`` wrote for this application."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
