"""Claims that arrive as a stream: idempotent appends, and counts of types over windows of creation time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimweave.model import SCHEMAS


def json_claims(spark: SparkSession, path: str) -> DataFrame:
    """A stream of nodes from JSON lines in a folder."""
    return spark.readStream.schema(SCHEMAS["nodes"]).json(path)


def append(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Write claims that the Parquet table does not hold yet. A batch that runs again after a failure adds nothing twice:
    its claims are looked up by id before they are written."""

    def put(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates(["id"])
        try:
            held = batch.sparkSession.read.schema(SCHEMAS["nodes"]).parquet(table).select("id")
            new = new.join(held, "id", "left_anti").select(*batch.columns)
        except Exception as missing:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(missing):
                raise
        new.write.mode("append").parquet(table)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(stream: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """(start, type, n): claims by type and window of their creation time, each id once; claims later than `late` are left out."""
    timed = stream.withColumn("at", F.to_timestamp(F.concat(F.substring("created_at", 1, 26), F.lit("Z"))))
    once = timed.withWatermark("at", late).dropDuplicatesWithinWatermark(["id"])
    return once.groupBy(F.window("at", window), "type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "type", "n")
