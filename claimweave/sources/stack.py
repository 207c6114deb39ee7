"""Stores in tiers: reads take what the upper tier holds, fetch the rest from below, and leave it above for the next time."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.storage import stored


class Stack:
    """An upper tier in a folder over a lower one. lower(ids): the rows of the ids (a column named as the key) that the lower tier has.

    What a read misses above is fetched once, answered, and written behind it into a folder of its own, so fills neither overwrite nor wait for one another. Rows are named by what they
    hold, so the same row filled twice, by repeated or concurrent reads, is the same: a read takes one of them. A fill that fails is no fault: the next read fetches again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, lower: Callable[[DataFrame], DataFrame], key: str = "id"):
        self.spark, self.path, self.schema, self.lower, self.key = spark, path.rstrip("/"), schema, lower, key
        self.filling: list[threading.Thread] = []

    def upper(self) -> DataFrame:
        """All rows of the upper tier, each once. Only fills that are complete count."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(self.path)
        files = place.getFileSystem(conf)
        done = [s.getPath() for s in files.listStatus(place)] if files.exists(place) else []
        done = [str(p) for p in done if p.getName().startswith("fill-") and files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        rows = self.spark.read.schema(self.schema).parquet(*done) if done else self.spark.createDataFrame([], self.schema)
        return rows.dropDuplicates([self.key])

    def get(self, ids: DataFrame) -> DataFrame:
        """The rows of the ids that either tier has."""
        wanted = stored(ids.select(self.key).distinct())
        above = self.upper().join(wanted, self.key, "left_semi")
        missed = stored(wanted.join(above.select(self.key), self.key, "left_anti"))
        if missed.isEmpty():
            return above
        columns = [c.split()[0] for c in self.schema.split(", ")]
        below = stored(self.lower(missed).select(*columns).dropDuplicates([self.key]))
        fill = threading.Thread(target=self._fill, args=(below,))
        self.filling = [t for t in self.filling if t.is_alive()] + [fill]
        fill.start()
        return above.select(*columns).unionByName(below)

    def _fill(self, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.path}/fill-{uuid.uuid4().hex}")

    def settle(self) -> None:
        """Wait for the fills under way."""
        for t in self.filling:
            t.join()

    def compact(self) -> None:
        """One fill with all rows; the others go once it is complete. For a time without reads."""
        self.settle()
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(self.path)
        files = place.getFileSystem(conf)
        old = [s.getPath() for s in files.listStatus(place)] if files.exists(place) else []
        self._fill(self.upper())
        for p in old:
            files.delete(p, True)


def healed(upper: DataFrame, lower: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """(key): ids that the upper tier lacks and the lower has: what a heal writes above."""
    return ids.select(key).distinct().join(upper.select(key), key, "left_anti").join(lower.select(F.col(key)), key, "left_semi")
