"""Path patterns: steps over typed references in either direction, hop ranges, and canonical routes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.errors import DanglingReference
from claimweave.functions.glob import matches_types
from claimweave.operators.closure import Deadline, levels
from claimweave.operators.kinds import Kinds, fits, references, rows
from claimweave.plans.query import CONNECTIONS, USES, Step

#: A step whose hops are bounded by this many is one lazy plan; longer and unbounded ones run level by level.
UNROLL = 3


def hop(level: DataFrame, edges: DataFrame, step: Step, inside: DataFrame | None, reverse: DataFrame | None = None, known: Kinds | None = None, kinds: frozenset[str] | None = None) -> DataFrame:
    """level with `b`, where one hop of a step leads from its id. inside: ids whose references reverse hops may see; arrivals are held against it, so that
    references are neither shuffled nor read for it. reverse: the references laid out by dst, for reverse hops. known, kinds: what ids tell, and the types of level."""
    wanted = matches_types(F.col("type"), step.edges)
    along = lambda links, a, b: level.join(links.where(wanted).select(F.col(a).alias("a"), F.col(b).alias("b")), level["id"] == F.col("a")).drop("a")
    parts = []
    if step.dir != USES:
        parts.append(along(references(known, edges, src=kinds), "src", "dst"))
    if step.dir in (USES, CONNECTIONS):
        back = along(references(known, edges if reverse is None else reverse, dst=kinds), "dst", "src")
        parts.append(back if inside is None else back.join(inside.select(F.col("id").alias("b")), "b", "left_semi").select(*back.columns))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def shortest(route: str = "route") -> Column:
    """How routes compare: fewer claims first, then claim by claim by creation and id."""
    return F.struct(F.size(route), F.col(route))


def stamped(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, route): routes of the one claim each."""
    return ids.select("id").distinct().join(nodes.select("id", "created_at_ns"), "id").select("id", F.array(F.struct("created_at_ns", "id")).alias("route"))


def onward(known: Kinds | None, step: Step, kinds: frozenset[str] | None) -> frozenset[str] | None:
    """The types that one hop of a step leads to."""
    if known is None or kinds is None:
        return None
    return (known.below(kinds, step.edges) if step.dir != USES else frozenset()) | (known.above(kinds, step.edges) if step.dir in (USES, CONNECTIONS) else frozenset())


def collected_kinds(known: Kinds | None, step: Step, kinds: frozenset[str] | None) -> frozenset[str] | None:
    """The types that a step from claims of these types collects."""
    if known is None or kinds is None:
        return None
    out = kinds if step.least == 0 else frozenset()
    # whatever some number of hops leads to, one below that of types leads to as well, beyond the least
    for n in range(1, (step.max or step.least + len(known.types)) + 1):
        kinds = onward(known, step, kinds)
        out |= kinds if n >= step.least else frozenset()
    return frozenset(k for k in out if fits(k, step.nodes))


def walk_step(frontier: DataFrame, step: Step, edges: DataFrame, nodes: DataFrame, scope: DataFrame | None, inside: DataFrame | None, routes: bool = False, deadline: Deadline | None = None, dangling: DataFrame | None = None, reverse: DataFrame | None = None, known: Kinds | None = None, kinds: frozenset[str] | None = None) -> DataFrame:
    """The distinct claims that one step collects from a frontier (id, and route if routes).

    A claim is expanded once, at its breadth-first depth; it is collected on each arrival whose hop lies in the step's range, also when the
    walk has been there before. Node patterns and the scope hold for what is collected, edge patterns for every hop. A
    route is that of a claim's first arrival in the step, whichever hop collects it. dangling (dst): ids that are referenced but not stored; a walk that arrives
    at one is refused. known, kinds: what ids tell, and the types of the frontier.
    """
    ends = collected_kinds(known, step, kinds)
    types = nodes.select("id", "type", *(["created_at_ns"] if routes else []))
    most = step.max or None
    lazy = 0 < step.max <= UNROLL and deadline is None

    def check(arrivals: DataFrame) -> None:
        if found := arrivals.select("id").join(dangling.select(F.col("dst").alias("id")), "id", "left_semi").take(1):
            raise DanglingReference(f"a path leads to {found[0].id}, which is not stored")

    def advance(level: DataFrame) -> DataFrame:
        nonlocal kinds
        before, kinds = kinds, onward(known, step, kinds)
        if not routes:
            return hop(level.select("id"), edges, step, inside, reverse, known, before).select(F.col("b").alias("id")).distinct()
        further = hop(level, edges, step, inside, reverse, known, before).select(F.col("b").alias("_b"), "route")
        further = further.join(rows(known, types, kinds).select(F.col("id").alias("_b"), "created_at_ns"), "_b", "inner" if dangling is None else "left").select(F.col("_b").alias("id"), F.concat("route", F.array(F.struct("created_at_ns", F.col("_b").alias("id")))).alias("route"))
        return further.groupBy("id").agg(F.min_by("route", shortest()).alias("route"))

    collected: list[DataFrame] = []
    first: list[DataFrame] = []
    start = frontier if routes else frontier.select("id")
    if step.least == 0:
        collected.append(start.withColumn("_hop", F.lit(0)))
    elif routes:
        first.append(start.withColumn("_hop", F.lit(0)).where(F.lit(False)))
    for n, arrivals in levels(start, advance, most, deadline, None if dangling is None else check, lazy):
        if routes:
            first.append(arrivals.withColumn("_hop", F.lit(n)))
        if n >= step.least:
            collected.append((arrivals if routes else arrivals.select("id")).withColumn("_hop", F.lit(n)))
    if not collected:
        return start.where(F.lit(False))
    out = collected[0]
    for more in collected[1:]:
        out = out.unionByName(more)
    if routes:
        every = out if step.least == 0 else None
        for more in first if every is None else first:
            every = more if every is None else every.unionByName(more)
        best = every.groupBy("id").agg(F.min_by("route", F.struct("_hop", F.size("route"), "route")).alias("route"))
        out = out.select("id").distinct().join(best, "id")
    else:
        out = out.select("id").distinct()
    if step.nodes:
        out = out.join(rows(known, types, ends).where(matches_types(F.col("type"), step.nodes)).select("id"), "id", "left_semi")
    return out if scope is None else out.join(scope.select("id"), "id", "left_semi")


def walk(start: DataFrame, steps: Sequence[Step], edges: DataFrame, nodes: DataFrame, scope: DataFrame | None, inside: DataFrame | None, routes: bool = False, deadline: Deadline | None = None, dangling: DataFrame | None = None, reverse: DataFrame | None = None, known: Kinds | None = None, kinds: frozenset[str] | None = None) -> DataFrame:
    """All steps in turn: each starts from what the one before collected. inside: ids whose references reverse hops may see.

    Only the last step's output answers a query: where the deadline cuts an earlier one short, nothing is found.
    """
    frontier = stamped(start, rows(known, nodes, kinds)) if routes else start.select("id").distinct()
    for i, step in enumerate(steps):
        frontier = walk_step(frontier, step, edges, nodes, scope, inside, routes, deadline, dangling, reverse, known, kinds)
        kinds = collected_kinds(known, step, kinds)
        if deadline is not None and i < len(steps) - 1 and deadline.over():
            return frontier.where(F.lit(False))
    return frontier


def gaps(ids: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst): references of the given claims to claims that are not stored."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst").join(nodes.select(F.col("id").alias("dst")), "dst", "left_anti")
