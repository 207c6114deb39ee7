"""A persistent archive: commits, races, crashes, reopening; and membership without closures."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from claimweave.errors import Conflict, Inadmissible, NotFound
from claimweave.model import SCHEMAS, Universe
from claimweave.operators import merge
from claimweave.operators.closure import closure
from claimweave.operators.membership import members, reaching
from claimweave.sources.snapshots import Contribution, Store, created_once

AT = "2026-01-01T00:00:00.000000000Z"


def tables(spark, claims):
    """claims: id -> (height, ids referenced, branches); type source/x, eve is the contributor."""
    kind = lambda i: "contribution/contributor" if i == "eve" else "source/x"
    nodes = [(i, kind(i), *kind(i).split("/"), None, None, None, None, AT, 1767225600000000000, None, None, h, {}, None) for i, (h, _) in claims.items()]
    edges = [(i, f"{i}-{k}", k, d, "derivation/x", "derivation", "x", 0, None, None, None, None, {}) for i, (_, refs) in claims.items() for k, d in enumerate(refs)]
    return spark.createDataFrame(nodes, SCHEMAS["nodes"]), spark.createDataFrame(edges, SCHEMAS["edges"])


def contribution(spark, claims, *heads):
    return Contribution(*tables(spark, claims), spark.createDataFrame(heads, "name string, id string"))


def branches(store, snapshot=None):
    """For each branch the plain claims that it holds."""
    now = snapshot or store.snapshot()
    u = store.universe(now)
    out = {}
    for r in u.branches.where(F.col("table_id") == now.head).collect():
        ids = closure(store.spark.createDataFrame([(r.head,)], "id string"), u.edges).join(u.nodes.where("type = 'source/x'").select("id"), "id", "left_semi")
        out[r.name] = "".join(sorted(x.id for x in ids.collect()))
    return out


FIRST = {"eve": (0, []), "a": (0, []), "b": (1, ["a"])}


def test_commits_and_reopening(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.snapshot().number == 0 and store.universe().nodes.count() == 0
    one = store.commit([contribution(spark, FIRST, ("main", "b"))], "eve", AT)
    two = store.commit([contribution(spark, {"c": (0, []), "a": (0, [])}, ("main", "c"), ("side", "a")), contribution(spark, {"d": (1, ["c"])}, ("main", "d"))], "eve", AT)
    assert (one.number, two.number, two.parent) == (1, 2, one.head) and branches(store) == {"main": "abcd", "side": "a"} and branches(store, one) == {"main": "ab"}
    nodes = store.universe().nodes
    assert nodes.count() == nodes.select("id").distinct().count() == 5 + 1 + 2  # five claims, a head over main's, two tables
    assert store.commit([contribution(spark, {"a": (0, [])}, ("main", "a"))], "eve", AT) == two  # nothing is new
    again = Store(spark, str(tmp_path))
    assert again.at(one.head) == one and branches(again) == {"main": "abcd", "side": "a"}
    assert {r.revision for r in again.universe().spine.collect()} == {1, 2}
    with pytest.raises(NotFound):
        again.at("nothing")
    whole = again.compact()
    assert whole.head == two.head and branches(again) == {"main": "abcd", "side": "a"} and all(len(f) <= 1 for f in whole.folders.values())


def test_two_writers_lose_nothing(spark, tmp_path):
    first = Store(spark, str(tmp_path))
    first.commit([contribution(spark, FIRST, ("main", "b"))], "eve", AT)
    rival, lost = Store(spark, str(tmp_path)), []

    def publish(path, text):
        if not lost:  # another writer is faster, and brings a claim that this one brings too
            lost.append(rival.commit([contribution(spark, {"x": (0, []), "y": (1, ["x"])}, ("main", "y"))], "eve", AT))
        return created_once(spark, path, text)

    got = Store(spark, str(tmp_path), publish).commit([contribution(spark, {"x": (0, []), "z": (1, ["x", "a"])}, ("main", "z"))], "eve", AT)
    assert (lost[0].number, got.number, got.parent) == (2, 3, lost[0].head) and branches(first) == {"main": "abxyz"}
    nodes = first.universe().nodes
    assert nodes.count() == nodes.select("id").distinct().count() and first.universe().edges.where("src = 'z'").count() == 2


def test_writers_in_threads(spark, tmp_path):
    Store(spark, str(tmp_path)).commit([contribution(spark, FIRST, ("main", "b"))], "eve", AT)
    given = [contribution(spark, {f"t{k}": (1, ["a"])}, ("main", f"t{k}")) for k in range(2)]
    threads = [threading.Thread(target=lambda c=c: Store(spark, str(tmp_path)).commit([c], "eve", AT)) for c in given]
    [t.start() for t in threads], [t.join() for t in threads]
    store = Store(spark, str(tmp_path))
    assert store.snapshot().number == 3 and branches(store) == {"main": "abt0t1"}


def test_crash_before_the_manifest(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    one = store.commit([contribution(spark, FIRST, ("main", "b"))], "eve", AT)

    def crash(path, text):
        raise OSError("power")

    with pytest.raises(OSError):
        Store(spark, str(tmp_path), crash).commit([contribution(spark, {"c": (0, [])}, ("main", "c"))], "eve", AT)
    assert store.snapshot() == one and branches(store) == {"main": "ab"}
    left = store.orphans(0)
    assert left and not set(left) & {f for own in one.folders.values() for f in own} and store.orphans() == []
    assert branches(store, store.commit([contribution(spark, {"c": (0, [])}, ("main", "c"))], "eve", AT)) == {"main": "abc"}


def test_refusals(spark, tmp_path):
    store = Store(spark, str(tmp_path), lambda path, text: False)
    with pytest.raises(Conflict):
        store.commit([contribution(spark, FIRST, ("main", "b"))], "eve", AT, attempts=2)
    with pytest.raises(Inadmissible):
        Store(spark, str(tmp_path)).commit([contribution(spark, FIRST, ("main", "gone"))], "eve", AT)
    assert created_once(spark, f"{tmp_path}/one", "x") and not created_once(spark, f"{tmp_path}/one", "y") and (tmp_path / "one").read_text() == "x"
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith(".one") and not p.name.endswith(".crc")] == []


def test_no_claim_is_older_than_what_it_references(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.commit([contribution(spark, FIRST, ("main", "b"))], "eve", "2020-01-01T00:00:00.000000000Z")
    assert {r.created_at for r in store.universe().nodes.collect()} == {AT}


def test_jobs_do_not_grow_with_branches(spark):
    nodes, edges = tables(spark, FIRST | {f"n{k}": (1, ["a"]) for k in range(30)})

    def jobs(n):
        group = f"merge-{n}"
        spark.sparkContext.setJobGroup(group, group)
        offered = spark.createDataFrame([(f"b{k}", f"n{k}") for k in range(n)] + [(f"b{k}", "b") for k in range(n)], "name string, id string")
        held = spark.createDataFrame([("t", f"b{k}", "b") for k in range(n)], SCHEMAS["branches"])
        made = merge.merged(Universe(nodes.unionByName(nodes.where("id = 'b'").withColumn("id", F.lit("t"))), edges, branches=held), "t", offered, "eve", AT)
        assert made.universe.branches.where(F.col("table_id") == made.id).count() == n
        assert made.new_edges.where("type = 'contribution/head'").count() == 2 * n
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(25) <= jobs(2) + 6
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_membership_against_closures(spark):
    r = random.Random(1)
    claims = {"eve": (0, [])}
    for k in range(40):
        refs = r.sample(sorted(claims), min(len(claims), r.randint(0, 3)))
        claims[f"c{k}"] = (1 + max((claims[i][0] for i in refs), default=-1), refs)
    nodes, edges = tables(spark, claims)
    below = {}
    for i, (_, refs) in claims.items():
        below[i] = {i}.union(*(below[x] for x in refs))
    asked = [(r.choice([*claims, "gone"]), r.choice([*claims, "gone"])) for _ in range(400)]
    got = {tuple(x) for x in reaching(spark.createDataFrame(asked, "id string, head string"), nodes, edges).collect()}
    assert got == {(i, h) for i, h in asked if h in below and i in below[h]}
    rows = spark.createDataFrame([("eve", "c1", 7), ("eve", "c1", 7), ("eve", None, 1)], "id string, head string, n int")
    out = members(rows, nodes, edges).collect()
    assert len(out) == 3 and {x.member for x in out if x.head == "c1"} == {"eve" in below["c1"]} and not next(x for x in out if x.head is None).member
    assert reaching(rows.limit(0), nodes, edges).count() == 0
