"""Diff chains resolved: a delta lies over the claim that its `contribution/diff` reference names.

A delta is an overlay: what it sets, what it omits of what lies below, and the claim below. Overlays compose, and composing is associative, so
each round lets every overlay take in the one that it lies over and reach twice as far: a chain of n claims takes log2(n) joins of n rows, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.errors import IntegrityError
from claimweave.storage import stored


def listed(fields: str, name: str) -> Column:
    """The names in a newline-separated field, trimmed, without empty ones."""
    value = F.coalesce(F.try_element_at(fields, F.lit(name)), F.lit(""))
    return F.filter(F.transform(F.split(value, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def over(upper: Column, omit: Column, lower: Column) -> Column:
    """The entries of one map over another's, less those that the upper one omits."""
    kept = F.map_filter(lower, lambda k, v: ~F.array_contains(omit, k) & ~F.map_contains_key(upper, k))
    return F.map_concat(kept, upper)  # no key on both sides


def composed(own: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, entries, at) of claims that lie over others. own: id, entries (map), omit (names), at (any value or null).

    entries are those of the whole chain below; at is the nearest that is not null. A chain ends at a claim that is not stored; one that meets itself is an IntegrityError.
    """
    below = edges.where("type = 'contribution/diff'").groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("next"))
    ends = below.select("id").unionByName(below.select(F.col("next").alias("id"))).distinct()
    state = stored(own.join(ends, "id", "left_semi").join(below, "id", "left"))
    deltas, reach = state.where("next is not null").count(), 1
    while not state.where("next is not null").isEmpty():
        if reach > deltas:
            raise IntegrityError(f"a diff chain meets itself: {state.where('next is not null').first().id}")
        lower = state.select(F.col("id").alias("next"), F.col("entries").alias("_entries"), F.col("omit").alias("_omit"), F.col("at").alias("_at"), F.col("next").alias("_next"))
        more = state.where("next is not null").join(lower, "next", "left")
        more = more.select("id", F.when(F.col("_entries").isNull(), F.col("entries")).otherwise(over(F.col("entries"), F.col("omit"), F.col("_entries"))).alias("entries"), F.array_union("omit", F.coalesce("_omit", F.array().cast("array<string>"))).alias("omit"), F.coalesce("at", "_at").alias("at"), F.col("_next").alias("next"))
        state = stored(state.where("next is null").unionByName(more))
        reach *= 2
    return state.select("id", "entries", "at")


def materialised(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Effective nodes. Fields: the predecessor's, less those that the delta's fields_diff_omit names, under the delta's own. Content comes whole from
    the nearest claim that has some, encoding and size with it. Where no diff is, the claim is as written."""
    own = nodes.select("id", F.coalesce("fields", F.create_map().cast("map<string,string>")).alias("entries"), listed("fields", "fields_diff_omit").alias("omit"), F.when(F.col("encoding").isNotNull(), F.col("id")).alias("at"))
    found = composed(own, edges).select("id", F.col("entries").alias("_fields"), F.col("at").alias("_at"))
    body = ("encoding", "content", "content_hash", "content_size")
    of = nodes.where("encoding is not null").select(F.col("id").alias("_at"), F.struct(*body).alias("_body"))
    out = nodes.join(found, "id", "left").join(of, "_at", "left")
    has = F.col("_fields").isNotNull()
    effective = {"fields": F.when(has, F.col("_fields")).otherwise(F.col("fields")), **{c: F.when(has, F.col("_body").getField(c)).otherwise(F.col(c)) for c in body}}
    return out.select(*(effective.get(c, F.col(c)).alias(c) for c in nodes.columns))


def materialised_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Effective references: named ones are inherited unless the delta omits or restates the name; unnamed ones are the claim's own only.

    What is composed is the claim that states a name, not the references; unnamed ones, however many a claim has, take no part.
    """
    name = F.try_element_at("fields", F.lit("name"))
    named = edges.withColumn("_name", name).where("_name is not null")
    stated = named.select("src", "_name").distinct().groupBy(F.col("src").alias("id")).agg(F.collect_list("_name").alias("names"))
    empty = F.array().cast("array<string>")
    own = nodes.select("id", listed("fields", "edges_diff_omit").alias("omit")).join(stated, "id", "left")
    own = own.select("id", F.map_from_entries(F.transform(F.coalesce("names", empty), lambda n: F.struct(n, F.col("id")))).alias("entries"), "omit", F.lit(None).cast("string").alias("at"))
    inherited = composed(own, edges).select("id", F.explode("entries").alias("_name", "_at")).where("id <> _at")
    return edges.unionByName(inherited.join(named.withColumnRenamed("src", "_at"), ["_at", "_name"]).withColumnRenamed("id", "src").select(*edges.columns))
