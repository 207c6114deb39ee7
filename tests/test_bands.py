"""Closures by height bands, and tables laid out in buckets."""

import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from claimweave.errors import IntegrityError
from claimweave.model import SCHEMAS, Universe
from claimweave.operators import bands
from claimweave.operators.closure import Deadline, closure
from claimweave.operators.traverse import walk_step
from claimweave.plans.query import Step
from claimweave.sources import store


def graph(spark, links, heights):
    nodes = spark.createDataFrame(list(heights.items()), "id string, height long")
    return nodes, spark.createDataFrame(links, "src string, dst string")


@pytest.mark.parametrize("narrow", [0, 20, 10_000])
def test_sweeps_against_closures(spark, narrow):
    r = random.Random(narrow)
    below, height, links = {}, {}, []
    for k in range(80):
        own = r.sample(sorted(height), min(len(height), r.choice([0, 1, 2, 3])))
        i = f"c{k}"
        height[i] = max((height[x] for x in own), default=-1) + 1 + r.choice([0, 0, 3])  # heights with gaps between them
        below[i] = {i}.union(*(below[x] for x in own))
        links += [(i, x) for x in own]
        if k % 9 == 0:
            links.append((i, f"gone{k}"))
            below[i] |= {f"gone{k}"}
    nodes, edges = graph(spark, links, height)
    made = bands.banded(nodes, bands.linked(nodes, edges), narrow)
    assert {x.dst for x in made.gaps().collect()} == {b for _, b in links if b.startswith("gone")}
    for heads in (["c79"], ["c3", "c50", "c50"], ["nothing"], []):
        got = [x.id for x in bands.swept(spark.createDataFrame([(h,) for h in heads], "id string"), made).collect()]
        want = set().union(*({"nothing"} if h == "nothing" else below[h] for h in heads))
        assert len(got) == len(set(got)) and set(got) == want




def test_a_chain_in_as_many_reads_as_bands(spark):
    n = 10_000
    ids = spark.range(n)
    name = lambda c: F.concat(F.lit("c"), c.cast("string"))
    nodes = ids.select(name(F.col("id")).alias("id"), F.col("id").alias("height"))
    links = ids.where("id > 0").select(name(F.col("id")).alias("src"), name(F.col("id") - 1).alias("dst"), F.col("id").alias("src_height"), (F.col("id") - 1).alias("dst_height"))
    made = bands.banded(nodes, links, 3000)
    assert len(made.narrow) == 4
    spark.sparkContext.setJobGroup("sweep", "sweep")
    got = bands.swept(spark.createDataFrame([(f"c{n - 1}",)], "id string"), made)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("sweep"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got.count() == n and jobs <= 10 * (len(made.narrow) + 1)


def test_references_have_to_lead_down(spark):
    nodes, edges = graph(spark, [("a", "b")], {"a": 1, "b": 1})
    with pytest.raises(IntegrityError):
        bands.banded(nodes, bands.linked(nodes, edges))


def shuffled_references(frame):
    """Whether a scan of references in the physical plan reaches its join by an exchange."""
    lines = frame._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for k, line in enumerate(lines):
        if "FileScan" in line and ("_edges" in line or "_reverse" in line):
            at = depth(line)
            for above in reversed(lines[:k]):
                if depth(above) < at:
                    at = depth(above)
                    if "Join" in above:
                        break
                    if "Exchange" in above:
                        return True
    return False


def test_hops_without_a_shuffle_of_references(spark, tmp_path):
    r = random.Random(7)
    claims = [f"c{k}" for k in range(300)]
    rows = spark.createDataFrame([(c, "source/x", "source", "x", None, None, None, None, "", 0, None, None, 0, {}, None) for c in claims], SCHEMAS["nodes"])
    links = sorted({(claims[r.randrange(k)], claims[k]) for k in range(1, 300) for _ in range(4)})
    edges = spark.createDataFrame([(b, f"{a}{b}", 0, a, "derivation/x", "derivation", "x", 0, None, None, None, None, {}) for a, b in links], SCHEMAS["edges"])
    written = store.save_bucketed(Universe(rows, edges), f"{tmp_path}/t", 4)
    again = store.open_bucketed(spark, f"{tmp_path}/t", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        start = spark.createDataFrame([("c40",), ("c200",)], "id string").repartition(3)
        for u in (written, again):
            for step in (Step(max=1), Step(dir="uses", max=1)):
                got = walk_step(start, step, u.edges, u.nodes, None, None, reverse=u.reverse)
                plain = walk_step(start, step, edges, rows, None, None)
                assert not shuffled_references(got) and {x.id for x in got.collect()} == {x.id for x in plain.collect()}
        assert shuffled_references(walk_step(start, Step(dir="uses", max=1), again.edges, again.nodes, None, None))  # without the copy by dst
        assert {x.id for x in closure(start, again.edges).collect()} == {x.id for x in closure(start, edges).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_time_limits_interrupt_a_level(spark):
    """The second level takes minutes: the walk ends soon after its limit with the first, and another job of the session goes on."""

    def slow(batches):
        for batch in batches:
            if "b" in batch.column(0).to_pylist():
                time.sleep(120)
            yield batch

    fast = spark.createDataFrame([("a", "b")], "src string, dst string")
    late = spark.createDataFrame([("b", "c")], "src string, dst string").mapInArrow(slow, "src string, dst string")
    start, other = spark.createDataFrame([("a",)], "id string"), []

    def meanwhile():
        def wait(batches):
            for batch in batches:
                time.sleep(8)
                yield batch

        other.append(spark.range(1).mapInArrow(wait, "id long").count())

    assert closure(start, fast).count() == 2  # the session is warm
    thread = threading.Thread(target=meanwhile)
    thread.start()
    deadline, began = Deadline(5), time.monotonic()
    found = closure(start, fast.unionByName(late), deadline=deadline)
    assert time.monotonic() - began < 5 + 3 and deadline.late
    assert [r.id for r in found.collect()] == ["a"]  # every level scans all references here, so the first one was given up
    thread.join()
    assert other == [1]
    whole = Deadline(60)
    assert {r.id for r in closure(start, fast, deadline=whole).collect()} == {"a", "b"} and not whole.late
    broken = fast.select(F.raise_error(F.lit("broken")).cast("string").alias("src"), "dst")
    with pytest.raises(Exception, match="broken"):
        closure(start, broken, deadline=Deadline(60))


def test_a_sweep_in_time(spark):
    nodes, edges = graph(spark, [("a", "b"), ("b", "c")], {"a": 2, "b": 1, "c": 0})
    made = bands.banded(nodes, bands.linked(nodes, edges), 0)
    start, past = spark.createDataFrame([("a",)], "id string"), Deadline(60)
    assert bands.swept(start, made, past).count() == 3 and not past.late
    past.at = 0
    assert bands.swept(start, made, past).count() < 3 and past.late
