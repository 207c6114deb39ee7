"""Whether claims lie in the closures of heads: many pairs at once, without any head's closure.

A claim lies above all that it references, so a path from a head down to a claim stays between their heights. The search starts at both ends, keeps to that
band, and in each round takes the side that has fewer references to follow; it ends where the sides meet, or where one has nothing left. Frontiers carry the head (or the claim) that they
belong to: one walk serves all pairs, and its rounds grow with the distance, not with the number of pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.operators.kinds import Kinds, met as kinds_of, references, rows
from claimweave.storage import stored


def reaching(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, known: Kinds | None = None) -> DataFrame:
    """The pairs (id, head), once each, whose claim lies in the closure of the head; a claim lies in its own. Claims and heads that are not stored lie nowhere and reach nothing.
    known: what ids tell of their claims."""
    heights = lambda kinds: rows(known, nodes, kinds).select("id", "height")
    pairs = stored(pairs.select("id", "head").distinct())
    kinds_down, kinds_up = kinds_of(known, pairs, "head"), kinds_of(known, pairs)
    asked = pairs.join(heights(kinds_up).withColumnRenamed("height", "low"), "id").join(heights(kinds_down).select(F.col("id").alias("head"), F.col("height").alias("high")), "head")
    asked = stored(asked.where("id = head or low < high"))
    found = asked.where("id = head").select("id", "head")
    open_ = asked.where("id <> head")
    # a side: its frontier and what it has seen (owner, at, bound), and how it goes on
    down = stored(open_.groupBy(F.col("head").alias("owner")).agg(F.min("low").alias("bound")).select("owner", F.col("owner").alias("at"), "bound"))
    up = stored(open_.groupBy(F.col("id").alias("owner")).agg(F.max("high").alias("bound")).select("owner", F.col("owner").alias("at"), "bound"))
    seen_down, seen_up = down, up
    while not (down.isEmpty() or up.isEmpty()):
        below = down.join(references(known, edges, src=kinds_down).select("src", "dst"), F.col("at") == F.col("src")).select("owner", "bound", F.col("dst").alias("at"))
        above = up.join(references(known, edges, dst=kinds_up).select("src", "dst"), F.col("at") == F.col("dst")).select("owner", "bound", F.col("src").alias("at"))
        descend = below.count() <= above.count()
        step, seen, inside = (below, seen_down, "height >= bound") if descend else (above, seen_up, "height <= bound")
        if known is not None:
            kinds_down, kinds_up = (known.below(kinds_down), kinds_up) if descend else (kinds_down, known.above(kinds_up))
        level = step.distinct().join(heights(kinds_down if descend else kinds_up).withColumnRenamed("id", "at"), "at").where(inside).drop("height").join(seen, ["owner", "at"], "left_anti").select("owner", "at", "bound")
        level = stored(level)
        own, other = ("head", "id") if descend else ("id", "head")
        meet = level.select(F.col("owner").alias(own), "at").join((seen_up if descend else seen_down).select(F.col("owner").alias(other), "at"), "at").select("id", "head").distinct()
        met = stored(meet.join(open_, ["id", "head"], "left_semi"))
        if descend:
            down, seen_down = level, seen_down.unionByName(level)
        else:
            up, seen_up = level, seen_up.unionByName(level)
        if not met.isEmpty():
            found = found.unionByName(met)
            open_ = stored(open_.join(met, ["id", "head"], "left_anti"))
            # heads and claims whose pairs are all answered go no further
            down = stored(down.join(open_.select(F.col("head").alias("owner")), "owner", "left_semi"))
            up = stored(up.join(open_.select(F.col("id").alias("owner")), "owner", "left_semi"))
    return found


def members(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, known: Kinds | None = None) -> DataFrame:
    """pairs (id, head, and any other columns) with `member`."""
    held = reaching(pairs, nodes, edges, known).withColumn("member", F.lit(True))
    return pairs.join(held, ["id", "head"], "left").withColumn("member", F.coalesce("member", F.lit(False)))
