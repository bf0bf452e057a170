"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; a temporary folder of our own only where that is unset and all runs on this machine."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="corrweave-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder; what is written there goes when the application ends."""
    folder = f"{shared_root(spark)}/{kind}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(where)
    store.deleteOnExit(where)
    return f"{folder}/rows"


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, kind: str, **options: str) -> DataFrame:
    """The rows from a table in the shared folder: written once, read as often and with as few columns as asked for."""
    path = shared_path(df.sparkSession, kind)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
