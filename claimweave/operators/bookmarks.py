"""Bookmark lists: heads of archives in order, addressed by list and index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.errors import Inadmissible


def latest(bookmarks: DataFrame) -> DataFrame:
    """(list, idx, head): the last bookmark of each list."""
    return bookmarks.groupBy("list").agg(F.max("idx").alias("idx"), F.max_by("head", "idx").alias("head"))


def between(bookmarks: DataFrame, start: int, end: int) -> DataFrame:
    """Bookmarks with start <= index < end."""
    return bookmarks.where(F.col("idx").between(start, end - 1))


def bounds(bookmarks: DataFrame) -> DataFrame:
    """(list, first, last): the ends of each list's indices."""
    return bookmarks.groupBy("list").agg(F.min("idx").alias("first"), F.max("idx").alias("last"))


def gaps(bookmarks: DataFrame) -> DataFrame:
    """(list, missing): lists whose indices are not consecutive."""
    ends = bookmarks.groupBy("list").agg((F.max("idx") - F.min("idx") + 1 - F.count_distinct("idx")).alias("missing"))
    return ends.where("missing > 0")


def appended(bookmarks: DataFrame, name: str, head: str, signer: str) -> DataFrame:
    """The list with one bookmark more; the same head again changes nothing."""
    last = bookmarks.where(F.col("list") == name).agg(F.max("idx").alias("idx"), F.max_by("head", "idx").alias("head")).first()
    if last.head == head:
        return bookmarks
    if not signer:
        raise Inadmissible("a bookmark needs a signer")
    idx = 0 if last.idx is None else last.idx + 1
    return bookmarks.unionByName(bookmarks.sparkSession.createDataFrame([(name, idx, head, signer, None)], bookmarks.schema))
