"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder and all executors are on this machine, as in tests.
LOCAL = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a cluster has to name one, since its machines' own folders are not shared."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", LOCAL if context.master.startswith("local") else None)
        if folder is None:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def reliable(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder, that goes with the application."""
    context = spark.sparkContext
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def stored(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Cut the lineage by a Parquet table. Its size is known to the planner, so small ones are broadcast; it goes with the application."""
    path = scratch(df.sparkSession, "table")
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
