"""Walks along references: the closure of some claims, and breadth-first levels."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.operators.kinds import Kinds, references
from claimweave.storage import stored


class Deadline:
    """A time that bounds a walk. late: whether a walk was cut short by it."""

    def __init__(self, seconds: float):
        self.at, self.late = time.monotonic() + seconds, False

    def over(self) -> bool:
        self.late = self.late or time.monotonic() > self.at
        return self.late

    def run(self, spark: SparkSession, work: Callable[[], DataFrame]) -> DataFrame | None:
        """What work returns; None where the time is over first. Its jobs bear a tag and are cancelled then, whatever they are at; other jobs of the session go on."""
        context, tag, done = spark.sparkContext, f"deadline-{uuid.uuid4().hex}", threading.Event()

        def watch() -> None:
            done.wait(max(0.0, self.at - time.monotonic()))
            while not done.is_set():  # again and again: work may be between two jobs
                context.cancelJobsWithTag(tag)
                done.wait(0.1)

        context.addJobTag(tag)
        watcher = threading.Thread(target=watch, daemon=True)
        watcher.start()
        try:
            return work()
        except Exception:
            if not self.over():
                raise
            return None
        finally:
            done.set()
            watcher.join()
            context.removeJobTag(tag)


def in_time(deadline: Deadline | None, spark: SparkSession, work: Callable[[], DataFrame]) -> DataFrame | None:
    """work within a deadline. One that is over before a walk begins cuts nothing short: walks look at it after each level, so their first one is answered."""
    return work() if deadline is None or time.monotonic() > deadline.at else deadline.run(spark, work)


def closure(start: DataFrame, edges: DataFrame, depth: int | None = None, stop_at: DataFrame | None = None, deadline: Deadline | None = None, known: Kinds | None = None, kinds: frozenset[str] | None = None) -> DataFrame:
    """Distinct ids reachable from start (a column id), start included, along edges src -> dst.

    depth: the longest chain of references, if known; the plan then has no action of its own. stop_at: ids whose references are known to be
    covered: they are neither returned nor walked through. deadline: once it is over, the level at work is given up, and the walk ends with those before. known, kinds: what ids
    tell, and the types of start; a level then looks only at the references that its types have.
    """
    level = start.select("id").distinct()
    if stop_at is not None:
        level = level.join(stop_at.select("id"), "id", "left_anti")

    def down() -> DataFrame:
        """What the level references; the next call is for the level below."""
        nonlocal kinds
        links = references(known, edges, kinds).select("src", "dst")
        if known is not None:
            kinds = known.below(kinds)
        return links

    if depth is not None:
        for _ in range(depth):
            # one reference to the level below: the plan grows by a join in each round
            links = edges.select("src", "dst") if stop_at is None else edges.select("src", "dst").join(stop_at.select(F.col("id").alias("dst")), "dst", "left_anti")
            level = level.join(links, level["id"] == links["src"], "left").select(F.explode(F.array_compact(F.array("id", "dst"))).alias("id")).distinct()
        return level
    # levels are tables whose size the planner knows: small ones are broadcast, and the references need no shuffle
    level = seen = stored(level)
    while True:
        found = level.join(links := down(), level["id"] == links["src"]).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        if stop_at is not None:  # of what is found, not of all references
            found = found.join(stop_at.select("id"), "id", "left_anti")
        level = in_time(deadline, start.sparkSession, lambda found=found: stored(found))
        if level is None or level.isEmpty():
            return seen
        seen = seen.unionByName(level)
        if deadline is not None and deadline.over():
            return seen


def levels(level: DataFrame, advance: Callable[[DataFrame], DataFrame], most: int | None, deadline: Deadline | None = None, check: Callable[[DataFrame], None] | None = None, lazy: bool = True):
    """Breadth-first levels: yields (hop, arrivals at that hop). advance makes arrivals of a level; each id is expanded once.

    Arrivals may hold ids seen before; only the next level leaves them out. lazy: up to `most` hops as one plan, without an action. check sees
    the arrivals of each hop, and may refuse them.
    """
    seen = level.select("id").distinct()
    hop = 0
    while most is None or hop < most:
        if lazy:
            arrivals = advance(level)
        else:
            arrivals = in_time(deadline, seen.sparkSession, lambda level=level: stored(advance(level)))
            if arrivals is None or arrivals.isEmpty():
                return
        if check is not None:
            check(arrivals)
        hop += 1
        yield hop, arrivals
        if most is None or hop < most:
            if deadline is not None and deadline.over():
                return
            level = arrivals.join(seen, "id", "left_anti").dropDuplicates(["id"])
            if not lazy:
                level = in_time(deadline, seen.sparkSession, lambda level=level: stored(level))
                if level is None:
                    return
            seen = seen.unionByName(level.select("id"))
