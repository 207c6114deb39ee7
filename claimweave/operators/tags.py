"""Mutable tags of claims, and the membership of branches at a point in time that they record."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions.glob import matches
from claimweave.operators.closure import closure
from claimweave.storage import stored

PREFIX = "_b_"


def tagged(tags: DataFrame, branch: str, claim: str) -> bool:
    return not tags.where((F.col("id") == claim) & (F.col("key") == PREFIX + branch)).isEmpty()


def members(tags: DataFrame, branch: str, height: int) -> DataFrame:
    """Ids that a branch held at the branch table of the given height."""
    return tags.where((F.col("key") == PREFIX + branch) & (F.try_to_number("value", F.lit("9" * 18)) <= height)).select("id").distinct()


def joined_at(tables: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, key, value): for each branch and claim the height of the first table whose head of that branch reaches it.

    tables: table, height, name, head. One walk serves all heads: it carries (name, height) along and keeps the least, since what an older table reaches
    every later one reaches too. A claim is carried on only where it is new to the branch, or reached by an older table than before.
    """
    links = edges.select("src", "dst")
    level = best = stored(tables.select(F.col("head").alias("id"), "name", "height").groupBy("id", "name").agg(F.min("height").alias("height")))
    while not level.isEmpty():
        found = level.join(links, level["id"] == links["src"]).select(F.col("dst").alias("id"), "name", "height").groupBy("id", "name").agg(F.min("height").alias("height"))
        known = best.groupBy("id", "name").agg(F.min("height").alias("known"))
        level = stored(found.join(known, ["id", "name"], "left").where("known is null or height < known").select("id", "name", "height"))
        best = best.unionByName(level)
    return best.groupBy("id", "name").agg(F.min("height").alias("height")).select("id", F.concat(F.lit(PREFIX), "name").alias("key"), F.col("height").cast("string").alias("value"))


def added(tags: DataFrame, new: DataFrame) -> DataFrame:
    """New tags where the claim has none of the key: the oldest wins."""
    return tags.unionByName(new.join(tags.select("id", "key"), ["id", "key"], "left_anti"))


def replaced(tags: DataFrame, claims: DataFrame, clear: Iterable[str], pairs: DataFrame) -> DataFrame:
    """Tags of the claims: keys that match a pattern are cleared, then the pairs (id, key, value) are put."""
    doomed = F.lit(False)
    for pattern in clear:
        doomed = doomed | matches(F.col("key"), pattern)
    gone = tags.join(claims.select("id"), "id", "left_semi").where(doomed).select("id", "key").unionByName(pairs.select("id", "key")).distinct()
    return tags.join(gone, ["id", "key"], "left_anti").unionByName(pairs)


def in_branches(ids: DataFrame, heads: DataFrame, edges: DataFrame, depth: int | None = None) -> DataFrame:
    """ids (with any columns, such as a position) with `member`: whether the closure of one of the heads (id) holds the claim."""
    inside = closure(heads, edges, depth).withColumn("member", F.lit(True))
    return ids.join(inside, "id", "left").withColumn("member", F.coalesce("member", F.lit(False)))


def spliced(spine: DataFrame, new: DataFrame) -> DataFrame:
    """A spine with its revisions from the first new one on replaced."""
    first = new.agg(F.min("revision").alias("_first"))
    return spine.join(F.broadcast(first), (F.col("revision") < F.col("_first")) | F.col("_first").isNull()).drop("_first").unionByName(new)
