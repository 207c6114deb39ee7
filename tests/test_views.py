"""Claims of the star schema as views: what queries write is bounded by the tables, whatever their ids would take."""

import os
from pathlib import Path

import pytest

import __spark_entry__
from claimweave.operators.kinds import Kinds, fits
from claimweave.plans.predicate import may_hold
from claimweave.plans.query import Where, leaf
from claimweave.sources import starschema
from claimweave.storage import shared_folder

SF = "/root/testdata/sf0.01"
#: Queries that a round of 1 GB stopped for their disk, by finding, and what they may write of the input's size.
STOPPED = {"verify_ids": 0.1, "verify_archive_head": 0.1, "path_uses": 2, "order_temporal": 2, "find_by_field": 0.1, "consolidate": 0.1, "closure_archive": 2, "archive_branch_tables": 2, "admit_branches": 0.1}


def written(spark):
    """Bytes that this session has shuffled, and those in its shared folder."""
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    folder = Path(shared_folder(spark).removeprefix("file:"))
    return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size())) + sum(p.stat().st_size for p in folder.rglob("*.parquet"))


@pytest.mark.parametrize("name", STOPPED)
def test_what_a_query_writes(spark, tmp_path, name):
    os.symlink(SF, tmp_path / "sf")  # a path of its own: nothing of an earlier query is used again
    size = sum(os.path.getsize(f"{SF}/{t}.parquet") for t in ("customer", "supplier", "part", "orders", "lineitem", "events"))
    before = written(spark)
    __spark_entry__.queries()[name](spark, str(tmp_path / "sf")).write.format("noop").mode("overwrite").save()
    assert written(spark) - before < STOPPED[name] * size


def test_kinds_against_the_tables(spark):
    """Every reference joins types that the links name, and ids tell the types of their claims."""
    u = starschema.universe(spark, "/root/testdata/sf0.001", spine=True)
    types = {r.id: r.type for r in u.nodes.select("id", "type").collect()}
    assert all(u.kinds.of(i) == {t} for i, t in types.items())
    assert {(types[r.src], r.type, types[r.dst]) for r in u.edges.select("src", "type", "dst").collect()} == u.kinds.links
    for kinds in ({"source/order"}, {"entity/customer", "contribution/head"}):
        got = {(r.src, r.dst) for r in u.kinds.references(u.edges, src=frozenset(kinds)).collect()}
        assert got == {(r.src, r.dst) for r in u.edges.select("src", "dst").collect() if types[r.src] in kinds}
        got = {(r.src, r.dst) for r in u.kinds.references(u.edges, dst=frozenset(kinds)).collect()}
        assert got == {(r.src, r.dst) for r in u.edges.select("src", "dst").collect() if types[r.dst] in kinds}
        assert {r.id for r in u.kinds.rows(u.nodes.select("id"), frozenset(kinds)).collect()} == {i for i, t in types.items() if t in kinds}
    assert u.dangling.count() == 0


def test_gaps_of_views(spark, tmp_path):
    """An order of a customer that is not stored, and one of none at all."""
    for f in Path("/root/testdata/sf0.001").iterdir():
        if f.name != "orders.parquet":
            os.symlink(f, tmp_path / f.name)
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    orders.selectExpr("o_orderkey", "case o_orderkey when 1 then 987654 when 2 then null else o_custkey end as o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    u = starschema.universe(spark, str(tmp_path), spine=True)
    assert [tuple(r) for r in u.dangling.select("kind", "dst").collect()] == [("source/order", "customer:987654")]


def test_claims_whose_ids_tell_nothing():
    known = Kinds({"a": "x/a", "b": "x/b"}, frozenset({("x/a", "to", "x/b")}))
    assert known.of("a:1", "nothing") == {"x/a"} and known.reached(frozenset({"x/a"})) == {"x/a", "x/b"}
    more = known.with_claims({"x/c"}, [("x/c", "over", known.of("a:1"))])
    assert more.of("bafy") == {"x/c"} and more.reached(more.of("bafy")) == {"x/a", "x/b", "x/c"} and more.above(frozenset({"x/a"})) == {"x/c"}


def test_filters_by_type():
    assert fits("derivation/customer", ("derivation/*",)) and not fits("derivation/customer", ("derivation/*", "-*/customer")) and fits("a/b", ())
    other = leaf("height", "ge", 3)
    for where, holds in ((leaf("type", "eq", "a/b"), True), (leaf("type", "ne", "a/b"), False), (leaf("type", "in", ["a/c"]), False), (leaf("type", "glob", "a/*"), True), (leaf("type", "glob", "a"), False), (other, None), (None, True),
                         (Where(all=(other, leaf("type", "eq", "x/y"))), False), (Where(any=(other, leaf("type", "eq", "x/y"))), None), (Where(no=leaf("type", "eq", "x/y")), True), (Where(no=other), None)):
        assert may_hold(where, "a/b") is holds
