"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULT = "/tmp/tidewalk-shared"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a session on a single machine without that setting gets a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (found or LOCAL_DEFAULT).rstrip("/")


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path, of any store that Spark reads, is a folder."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(found).isDirectory()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in this application's folder, which goes when the application ends."""
    root = f"{shared_dir(spark)}/tidewalk-feed/{spark.sparkContext.applicationId}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        files.mkdirs(folder)
        files.deleteOnExit(folder)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def by_key(df: DataFrame) -> DataFrame:
    """df for joins in which its rows meet by key in any case: a written table's size is that of packed files, and as a hash table in the driver its rows take many times that."""
    return df.hint("merge")


def cut(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write once and read back, so that loops don't grow their lineage and lost executors cost little; by: last columns, with a folder for each of their values."""
    path = new_path(df.sparkSession, name)
    (df.repartition(*by).write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
