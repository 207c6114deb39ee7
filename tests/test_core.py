"""The query language, walks, overlays and codecs: exact answers, refusals, and a differential test of the walk."""

import json
import random
import time
from dataclasses import replace
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from claimweave import errors
from claimweave.functions import cbor, edtf, ids, wire
from claimweave.functions.glob import matches, matches_types
from claimweave.model import Universe
from claimweave.operators import bookmarks, lookup, overlay, sync, tags
from claimweave.operators.closure import Deadline, closure
from claimweave.operators.traverse import walk_step
from claimweave.plans import query as q
from claimweave.plans.engine import Archive, budget
from claimweave.plans.predicate import filter_of, printed
from claimweave.plans.query import Content, Key, Output, Query, Step, Where, leaf

# A harbour's archive: scans and a logbook, what was read off them, a voyage between them, and an edition of it all.
NODES = {
    "ada": ("contribution/contributor", 0, {}), "scan1": ("source/scan", 1, {"page": "7"}), "scan2": ("source/scan", 1, {"page": "12"}), "log": ("source/logbook", 1, {}),
    "lund": ("entity/place", 2, {"name": "Lund"}), "brig": ("entity/vessel", 2, {"name": "Brig", "tonnage": "310"}), "trip": ("relation/voyage", 3, {}), "reading": ("derivation/reading", 4, {"note": "x"}), "edition": ("derivation/edition", 5, {}),
}
EDGES = [
    ("scan1", "ada", "contribution/contributor"), ("scan2", "ada", "contribution/contributor"), ("log", "ada", "contribution/contributor"), ("lund", "scan1", "derivation/seen"), ("brig", "scan2", "derivation/seen"), ("trip", "lund", "relation/from"), ("trip", "brig", "relation/of"),
    ("reading", "trip", "derivation/input"), ("reading", "log", "derivation/input"), ("edition", "reading", "derivation/input"), ("edition", "scan1", "derivation/cites"),
]
EVERY = set(NODES)
BODIES = {"log": b"wind from the west", "lund": b"abcde", "reading": b"0123456789"}
EDGE_BODIES = {("reading", "trip"): b"first", ("reading", "log"): b"second"}


@pytest.fixture(scope="module")
def harbour(spark):
    rows = []
    for i, (kind, height, fields) in NODES.items():
        body = BODIES.get(i)
        rows.append((i, kind, *kind.split("/"), "text/plain" if body else None, body, len(body) if body else None, f"2031-05-0{height + 1}T08:00:00.000000000Z", height, height, fields))
    nodes = spark.createDataFrame(rows, "id string, type string, type_class string, type_sub string, encoding string, content binary, content_size long, created_at string, created_at_ns long, height long, fields map<string,string>").selectExpr("*", "cast(null as string) content_hash", "cast(null as string) dated", "cast(null as long) dated_mid_ms")
    edges, place = [], {}
    for a, b, kind in EDGES:
        body = EDGE_BODIES.get((a, b))
        place[a] = place.get(a, -1) + 1
        edges.append((a, b, kind, *kind.split("/"), place[a], {"relation/from": -1, "relation/of": 1}.get(kind, 0), "text/plain" if body else None, body, len(body) if body else None, {"name": f"to {b}"} if a == "trip" else {}))
    edges = spark.createDataFrame(edges, "src string, dst string, type string, type_class string, type_sub string, ord int, relation_direction int, encoding string, content binary, content_size long, fields map<string,string>").selectExpr("*", "concat(src, '>', dst) edge_id", "cast(null as string) content_hash")
    branches = spark.createDataFrame([("table", "main", "edition"), ("table", "ships", "brig")], "table_id string, name string, head string")
    return Archive(Universe(nodes.cache(), edges.cache(), branches=branches), "table")


def got(archive, head="edition", **kw):
    return {r.id for r in archive.query(Query("$universe", head=head, **kw)).rows.select("id").collect()}


@pytest.mark.parametrize(("where", "want"), [
    (Where(all=(leaf("height", "ge", 2), leaf("type", "glob", "entity/[p-v]*"), leaf("name", "ne", "Brig"))), {"lund"}),
    (Where(any=(leaf("type", "eq", "relation/voyage"), leaf("page", "in", ["7", 12]))), {"trip", "scan1", "scan2"}),
    (Where(no=leaf("type", "glob", "*/[s-v]*")), {"ada", "log", "lund", "reading", "edition"}),
    (leaf("name", "ne", "Lund"), {"brig"}), (leaf("height", "lt", 1), {"ada"}), (leaf("height", "le", 1.5), {"ada", "scan1", "scan2", "log"}), (leaf("height", "gt", 4), {"edition"}),
    (leaf("tonnage", "eq", "none"), set()), (Where(no=leaf("tonnage", "eq", "310")), EVERY - {"brig"}), (Where(no=Where(no=leaf("note", "eq", "x"))), {"reading"}),
    (leaf("type", "glob", "derivation*"), set()), (leaf("type", "glob", "?????*/*"), EVERY), (leaf("tonnage", "eq", 310), {"brig"}), (leaf("tonnage", "gt", 5), set()), (leaf("tonnage", "lt", "4"), {"brig"}), (leaf("content_size", "gt", 6), {"log", "reading"}),
])
def test_filters(harbour, where, want):
    assert got(harbour, where=where) == want


@pytest.mark.parametrize(("claim", "steps", "want"), [
    ("edition", (Step(nodes=("source/*", "-source/logbook")),), {"scan1", "scan2"}),
    ("edition", (Step(("-relation/*",), min=0),), {"edition", "reading", "scan1", "ada", "trip", "log"}),
    ("scan1", (Step(dir="uses", edges=("derivation/*",), max=1), Step(dir="uses")), {"edition", "trip", "reading"}),
    ("edition", (Step(min=2, max=2),), {"trip", "log", "ada"}),
    ("trip", (Step(("relation/*",), dir="connections", min=2, max=2),), {"trip"}),
    ("edition", (Step(("derivation/*",), min=3),), set()),
])
def test_paths(harbour, claim, steps, want):
    assert got(harbour, claim=claim, path=steps) == want


def test_scopes_confine_what_is_collected(harbour):
    rows = harbour.query(Query("ships", claim="trip", path=(Step(min=0),))).rows
    assert {r.id for r in rows.collect()} == {"brig", "scan2", "ada"}
    assert {r.id for r in harbour.query(Query("ships", head="log")).rows.collect()} == {"ada"}
    assert {r.id for r in harbour.query(Query("ships", claim="scan2", path=(Step(dir="uses"),))).rows.collect()} == {"brig"}


def test_routes_and_order(harbour):
    rows = harbour.query(Query("$universe", head="edition", claim="edition", path=(Step(),), output=Output("path", "id"))).rows.collect()
    routes = {r.id: list(r.route) for r in rows}
    assert routes["scan1"] == ["edition", "scan1"] and routes["brig"] == ["edition", "reading", "trip", "brig"] and {r.kind for r in rows} == {"path_id"}
    for way in ("asc", "desc"):
        ordered = [r.id for r in harbour.query(Query("$universe", head="edition", order=(Key("page", dir=way),), results=4)).rows.collect()]
        assert ordered == [*(["scan2", "scan1"] if way == "asc" else ["scan1", "scan2"]), "ada", "log"]
    bounded = harbour.query(Query("$universe", head="edition", results=2))
    assert bounded.truncated() and bounded.rows.count() == 2 and not harbour.query(Query("$universe", head="edition", results=9)).truncated()
    assert {(r.src, r.dst) for r in harbour.query(Query("$universe", head="lund")).references.collect()} == {("lund", "scan1"), ("scan1", "ada")}


def test_native_claims_along_a_route(harbour):
    query = Query("$universe", head="edition", claim="reading", path=(Step(max=2),), where=leaf("id", "eq", "lund"), output=Output("path"))
    row = harbour.query(query).rows.first()
    assert row.kind == "path_native" and list(row.route) == ["reading", "trip", "lund"]
    assert [(c.id, c.height, c.fields) for c in row.claims] == [("reading", 4, {"note": "x"}), ("trip", 3, {}), ("lund", 2, {"name": "Lund"})]
    coded = harbour.query(Query(**{**query.__dict__, "output": Output("path", encoding="json")})).rows.first()
    assert coded.kind == "path_encoded" and [json.loads(c)["id"] for c in coded.claims] == ["reading", "trip", "lund"] and json.loads(coded.encoded)["id"] == "lund"


def json_of(archive, claim, content=None, encoding="json"):
    rows = archive.query(Query("$universe", head="edition", where=leaf("id", "eq", claim), output=Output(content=content, encoding=encoding))).rows
    return rows.first().encoded


@pytest.mark.parametrize(("content", "first", "second", "own"), [
    (None, None, None, None), (Content(), b"first", b"second", b"0123456789"), (Content(7), b"first", None, None), (Content(7, "cutoff"), b"first", b"se", None), (Content(5, "cutoff"), b"first", None, None), (Content(13), b"first", b"second", None), (Content(13, "cutoff"), b"first", b"second", b"01"), (Content(21), b"first", b"second", b"0123456789"),
])
def test_contents_within_a_cap(harbour, content, first, second, own):
    claim = json.loads(json_of(harbour, "reading", content))
    import base64

    body = lambda x: None if "content" not in x else base64.b64decode(x["content"])
    assert [body(e) for e in claim["edges"]] == [first, second] and body(claim) == own
    assert claim["content_size"] == 10 and [e["content_size"] for e in claim["edges"]] == [5, 6] and [e["reference"] for e in claim["edges"]] == ["trip", "log"]
    node, edges = wire.decode_claim(bytes(json_of(harbour, "reading", content, "cbor")))
    assert [e["content"] for e in edges] == [first, second] and node["content"] == own and node["content_size"] == 10
    native = harbour.query(Query("$universe", head="edition", where=leaf("id", "eq", "reading"), output=Output(content=content))).rows.first()
    assert (native.content and bytes(native.content)) == (b"0123456789" if content is None else own) and native.content_size == 10


def test_json_of_a_claim(harbour):
    claim = json.loads(json_of(harbour, "trip"))
    assert claim == {"id": "trip", "type": "relation/voyage", "created_at": "2031-05-04T08:00:00.000000000Z", "height": 3, "edges": [{"type": "relation/from", "reference": "lund", "relation_direction": -1, "fields": {"name": "to lund"}}, {"type": "relation/of", "reference": "brig", "relation_direction": 1, "fields": {"name": "to brig"}}]}
    assert list(claim) == sorted(claim)


def test_records_round_trip(spark, harbour):
    node, edges = wire.decode_claim(bytes(json_of(harbour, "trip", Content(), "cbor")))
    assert (node["type"], node["height"], node["created_at"]) == ("relation/voyage", 3, "2031-05-04T08:00:00.000000000Z")
    assert [(e["dst"], e["type"], e["relation_direction"], e["fields"]) for e in edges] == [("lund", "relation/from", -1, {"name": "to lund"}), ("brig", "relation/of", 1, {"name": "to brig"})]
    raw = wire.encode_claim({"type_class": "source", "type_sub": "note", "encoding": "text/markdown", "content": b"hi", "content_size": 2, "created_at": "2031-01-01T00:00:00.000000000Z", "fields": {"name": "n", "own": "o"}}, [{"type_class": "contribution", "type_sub": "contributor", "reference": ids.address(b"k")}])
    top = cbor.decode(raw)
    assert [top[k] for k in (1, 2, 3, 4, 8)] == [".s", "note", ".t", ".m", {".n": "n", "own": "o"}]
    assert top[10] == [{1: ".c", 2: ".c", 12: ids.MULTIHASH + ids.digest_of(ids.address(b"k"))}]
    frame = spark.createDataFrame([(raw,)], "record binary")
    row, ref = wire.nodes_of(frame).first(), wire.edges_of(frame).first()
    assert (row.id, row.type, row.encoding, bytes(row.content), row.fields, row.height) == (ids.address(raw), "source/note", "text/markdown", b"hi", {"name": "n", "own": "o"}, 0)
    assert (ref.src, ref.dst, ref.type, ref.ord, ref.relation_direction) == (row.id, ids.address(b"k"), "contribution/contributor", 0, 0)
    for bad in (b"\x01", cbor.encode({99: 1}), b""):
        with pytest.raises((ValueError, IndexError)):
            wire.decode_claim(bad)


def test_contribution_streams():
    declared, payload = wire.contribution([cbor.encode(x) for x in ([2, ["a", "b"]], [3, ["$archive"]], [2, ["b", "c"]], [3, ["x"]], [5, ["n"]], [0, b"id", b"claim", "b"], [1, b"hash", b"body"])])
    assert declared == {"branches": ["b"], "referencable": ["x"], "creatable": ["n"]}
    assert payload == [(0, "id", b"claim", "b"), (1, "hash", b"body", None)]
    for bad in ([[0, b"i", b"c", "b"]], [[2, []], [0, b"i", b"c", "b"]], [[2, []], [3, []], [1, b"h", b"x"], [4, []]], [[9, []]], [7]):
        with pytest.raises(errors.MalformedRecord):
            wire.contribution([cbor.encode(x) for x in bad])
    both = wire.narrow({"branches": ["a", "b"], "referencable": ["$universe", "a"]}, {"branches": ["b"], "referencable": ["$archive"], "lifted": ["t"]})
    assert both == {"branches": ["b"], "referencable": ["$archive"], "lifted": [], "creatable": []}


def test_gaps_refuse_a_walk(spark, harbour):
    u = harbour.universe
    torn = Archive(u.with_(nodes=u.nodes.where("id <> 'scan2'")), "table")
    for query in (Query("$universe", head="edition"), Query("main"), Query("$universe", head="brig", claim="brig", path=(Step(),)), Query("$universe", head="brig", claim="brig", path=(Step(max=1),)), Query("$universe", head="brig", claim="brig", path=(Step(max=1),), output=Output("path", "id"))):
        with pytest.raises(errors.DanglingReference):
            torn.query(query)
    assert got(torn, head="lund") == {"lund", "scan1", "ada"}
    rows = torn.query(Query("$universe", head="lund", claim="trip", path=(Step(("relation/from",)),))).rows
    assert [r.id for r in rows.collect()] == ["lund"]


@pytest.mark.parametrize("query", [Query("$universe", head="nothing"), Query("$universe", head="ada", claim="nothing", path=(Step(),)), Query("nowhere"), Query("main", claim="nothing")])
def test_what_is_not_there(harbour, query):
    with pytest.raises(errors.NotFound):
        harbour.query(query)


def test_time_bounds_the_walk(harbour):
    fresh = lambda: Archive(harbour.universe, "table")
    scan = fresh().query(Query("$universe", head="edition", seconds=1e-9))
    assert scan.late and scan.truncated() and {r.id for r in scan.rows.collect()} < EVERY
    one = fresh().query(Query("$universe", head="edition", claim="edition", path=(Step(max=3),), seconds=1e-9))
    assert one.late and {r.id for r in one.rows.collect()} == {"reading", "scan1"}
    two = fresh().query(Query("$universe", head="edition", claim="edition", path=(Step(max=3), Step(max=1)), seconds=1e-9))
    assert two.late and two.rows.count() == 0
    with pytest.raises(errors.TimedOut):
        fresh().query(Query("main", seconds=1e-9))
    ample = fresh().query(Query("$universe", head="edition", claim="edition", path=(Step(max=3),), seconds=600))
    assert not ample.late and {r.id for r in ample.rows.collect()} == {"reading", "scan1", "trip", "log", "ada", "lund", "brig"}


def test_single_claims_and_branches(spark, harbour):
    assert harbour.get("main", "brig").first().type == "entity/vessel" and harbour.holds("ships", "scan2") and not harbour.holds("ships", "lund") and harbour.holds("$universe", "ada", ("lund", "log"))
    with pytest.raises(errors.NotFound):
        harbour.get("ships", "lund")
    tagged = Archive(harbour.universe.with_(tags=spark.createDataFrame([("lund", "_b_ships", "1")], "id string, key string, value string")), "table")
    assert tagged.holds("ships", "lund")
    assert harbour.has_branch("main") and not harbour.has_branch("maine") and [r.name for r in harbour.missing_branches(["ships", "x"]).collect()] == ["x"]
    assert harbour.previous("main") is None
    edges = harbour.universe.edges
    assert {r.dst for r in lookup.references(edges.where("src = 'trip'"), type_="relation/of").collect()} == {"brig"}
    assert {r.dst for r in lookup.references(edges, types=["relation/of", "relation/from"], field=("name", "to lund")).collect()} == {"lund"}
    assert lookup.references(edges, field=("none", "")).count() == 0
    asked = spark.createDataFrame([(0, "brig"), (1, "nothing"), (2, "ada"), (3, "brig")], "position int, id string")
    assert [(r.id, r.held, r.height) for r in lookup.positioned(asked, harbour.universe.nodes).collect()] == [("brig", True, 2), ("nothing", False, None), ("ada", True, 0), ("brig", True, 2)]
    assert lookup.without(harbour.universe.nodes, asked).count() == len(NODES) - 2


def test_reports(harbour):
    said = lambda level: [(e.level, e.step) for e in harbour.query(Query("main", path=(Step(max=1),), report=level)).report.events]
    assert said("") == [] and said("info") == [("info", "scope"), ("info", "filter"), ("info", "results")] and ("debug", "step") in said("debug")
    events = harbour.query(Query("main", report="trace")).report.events
    assert [e.seconds for e in events] == sorted(e.seconds for e in events)


def test_rows_of_reports(harbour):
    """Counts equal those of separate queries; the answer itself is the same as without a report."""
    for q in (Query("main", where=leaf("height", "ge", 1), results=1), Query("main", path=(Step(max=2),), output=Output("path"))):
        plain, told = harbour.query(q), harbour.query(replace(q, report="debug"))
        rows = {e.step: e.rows for e in told.report.events}
        everything = harbour.query(replace(q, where=None, results=0)).rows.count()
        assert (rows["reached"], rows["filter"], rows["results"]) == (everything, harbour.query(replace(q, results=0)).rows.count(), plain.rows.count())
        assert [r.id for r in told.rows.collect()] == [r.id for r in plain.rows.collect()]
        assert all(e.rows is None for e in harbour.query(replace(q, report="info")).report.events)


def reference_step(edges, start, step):
    """Levels by hand: a node is expanded once, an arrival counts wherever it ends."""
    depth, collected, level = dict.fromkeys(start, 0), set(start) if step.least == 0 else set(), set(start)
    hop = 0
    while level and (not step.max or hop < step.max):
        hop += 1
        arrived = {b for a, b in edges if a in level}
        if hop >= step.least:
            collected |= arrived
        level = {b for b in arrived if b not in depth}
        depth |= dict.fromkeys(level, hop)
    return collected


@pytest.mark.parametrize("seed", range(3))
def test_walk_against_levels(spark, seed):
    r = random.Random(seed)
    pairs = sorted({(f"n{r.randrange(12)}", f"n{r.randrange(12)}") for _ in range(22)})
    edges = spark.createDataFrame([(a, b, "derivation/x") for a, b in pairs], "src string, dst string, type string")
    nodes = spark.createDataFrame([(f"n{k}", "source/x", k) for k in range(12)], "id string, type string, created_at_ns long")
    start = spark.createDataFrame([("n0",), ("n1",)], "id string")
    for step in (Step(max=2), Step(min=2, max=3), Step(dir="uses", min=0)):
        hops = [(b, a) for a, b in pairs] if step.dir == "uses" else pairs
        assert {x.id for x in walk_step(start, step, edges, nodes, None, None).collect()} == reference_step(hops, {"n0", "n1"}, step)


def test_closure_in_one_plan(spark, harbour):
    start = spark.createDataFrame([("trip",)], "id string")
    for depth in (None, 4):
        assert {r.id for r in closure(start, harbour.universe.edges, depth).collect()} == {"trip", "lund", "brig", "scan1", "scan2", "ada"}
    assert {r.id for r in sync.missing_claims(harbour.universe, start, spark.createDataFrame([("scan1",), ("brig",)], "id string")).collect()} == {"trip", "lund"}
    late = Deadline(1e-9)
    time.sleep(0.01)
    assert {r.id for r in closure(start, harbour.universe.edges, deadline=late).collect()} == {"trip", "lund", "brig"} and late.late


def test_overlay(spark):
    nodes = spark.createDataFrame([("k1", {"colour": "red", "size": "3", "shape": "round"}, "text/plain", b"kept"), ("k2", {"size": "4", "fields_diff_omit": "colour\n shape "}, None, None), ("k3", {"colour": "blue"}, None, None), ("k4", {}, "text/html", b"new"), ("lost", {"a": "b"}, None, None)], "id string, fields map<string,string>, encoding string, content binary").selectExpr("*", "cast(null as string) content_hash", "cast(length(content) as long) content_size")
    edges = spark.createDataFrame([("k2", "k1", "contribution/diff", {}), ("k3", "k2", "contribution/diff", {}), ("k4", "k3", "contribution/diff", {}), ("lost", "gone", "contribution/diff", {}), ("k1", "s", "derivation/d", {"name": "n"}), ("k1", "s2", "derivation/d", {"name": "m"}), ("k1", "t", "derivation/d", {}), ("k3", "u", "derivation/d", {"name": "n"})], "src string, dst string, type string, fields map<string,string>")
    rows = {r.id: r for r in overlay.materialised(nodes, edges).collect()}
    assert rows["k2"].fields == {"size": "4", "fields_diff_omit": "colour\n shape "} and rows["k3"].fields == {"size": "4", "fields_diff_omit": "colour\n shape ", "colour": "blue"}
    assert (bytes(rows["k3"].content), rows["k3"].content_size, rows["k4"].encoding, bytes(rows["k4"].content)) == (b"kept", 4, "text/html", b"new") and rows["lost"].fields == {"a": "b"} and rows["k1"].fields["colour"] == "red"
    omitting = nodes.withColumn("fields", F.when(F.col("id") == "k4", F.create_map(F.lit("edges_diff_omit"), F.lit("m"))).otherwise(F.col("fields")))
    own = {(r.src, r.dst) for r in overlay.materialised_edges(omitting, edges).where("type like 'derivation/%'").collect()}
    assert own == {("k1", "s"), ("k1", "s2"), ("k1", "t"), ("k2", "s"), ("k2", "s2"), ("k3", "u"), ("k3", "s2"), ("k4", "u")}


def test_overlay_of_long_chains_and_circles(spark):
    n = 700
    nodes = spark.range(n).selectExpr("concat('c', id) id", "case when id % 100 = 0 then map(concat('f', id), 'v') else map() end fields", "cast(null as string) encoding", "cast(null as binary) content", "cast(null as string) content_hash", "cast(null as long) content_size")
    edges = spark.range(1, n).selectExpr("concat('c', id) src", "concat('c', id - 1) dst", "'contribution/diff' type", "cast(map() as map<string,string>) fields")
    sizes = {r.id: r.n for r in overlay.materialised(nodes.withColumn("fields", F.col("fields").cast("map<string,string>")), edges).selectExpr("id", "size(fields) n").collect()}
    assert all(sizes[f"c{k}"] == k // 100 + 1 for k in range(n))
    ring = edges.unionByName(spark.createDataFrame([("c0", "c2", "contribution/diff", {})], "src string, dst string, type string, fields map<string,string>"))
    with pytest.raises(errors.IntegrityError):
        overlay.materialised(nodes.withColumn("fields", F.col("fields").cast("map<string,string>")), ring)


def test_membership_over_time(spark):
    edges = spark.createDataFrame([("h2", "h1"), ("h2", "b"), ("h1", "a"), ("a", "z"), ("b", "z"), ("b", "b2"), ("b2", "b3")], "src string, dst string")
    tables = spark.createDataFrame([("t1", 3, "x", "h1"), ("t2", 7, "x", "h2"), ("t2", 7, "y", "b")], "table string, height long, name string, head string")
    found = {(r.id, r.key, r.value) for r in tags.joined_at(tables, edges).collect()}
    assert found == {("h1", "_b_x", "3"), ("a", "_b_x", "3"), ("z", "_b_x", "3"), ("h2", "_b_x", "7"), *((i, "_b_x", "7") for i in ("b", "b2", "b3")), *((i, "_b_y", "7") for i in ("b", "b2", "b3", "z"))}
    spine = spark.createDataFrame([("t1", 1), ("t2", 2), ("t3", 3)], "id string, revision int")
    assert {(r.id, r.revision) for r in tags.spliced(spine, spark.createDataFrame([("n2", 2), ("n3", 3), ("n4", 4)], spine.schema)).collect()} == {("t1", 1), ("n2", 2), ("n3", 3), ("n4", 4)}
    assert tags.spliced(spine, spine.limit(0)).count() == 3


def test_tags_and_bookmarks(spark):
    held = spark.createDataFrame([("m", "_b_a", "5"), ("late", "_b_a", "9"), ("m", "note", "x")], "id string, key string, value string")
    assert [r.id for r in tags.members(held, "a", 5).collect()] == ["m"]
    pairs = spark.createDataFrame([("m", "_b_c", "7")], held.schema)
    assert {(r.id, r.key) for r in tags.replaced(held, spark.createDataFrame([("m",)], "id string"), ["_b_*"], pairs).collect()} == {("late", "_b_a"), ("m", "note"), ("m", "_b_c")}
    marks = spark.createDataFrame([("l", 0, "h0", "s", None), ("l", 1, "h1", "s", None), ("k", 0, "x", "s", None), ("k", 2, "y", "s", None)], "list string, idx long, head string, signer string, slot string")
    assert {(r.list, r.head) for r in bookmarks.latest(marks).collect()} == {("l", "h1"), ("k", "y")}
    assert [r.list for r in bookmarks.gaps(marks).collect()] == ["k"]
    assert bookmarks.appended(marks, "l", "h2", "s").count() == 5 and bookmarks.appended(marks, "l", "h1", "s").count() == 4


def test_globs(spark):
    frame = spark.createDataFrame([("source/note",), ("a",), ("b/c",), ("*",), ("-",)], "t string")
    hits = lambda p: {r.t for r in frame.where(matches(F.col("t"), p)).collect()}
    assert hits("*") == {"a", "*", "-"} and hits("*/*") == {"source/note", "b/c"} and hits("[a-c]") == {"a"} and hits("[^a]") == {"*", "-"}
    assert hits(r"\*") == {"*"} and hits(r"[\-]") == {"-"} and hits("?/c") == {"b/c"}
    assert not any(hits(p) for p in ("[a-", "[]", "a\\", "[", "[a"))
    assert {r.t for r in frame.where(matches_types(F.col("t"), ["-a"])).collect()} == {"source/note", "b/c", "*", "-"}


def ms(y, m=1, d=1, h=0, mi=0, s=0):
    return int(datetime(y, m, d, h, mi, s, tzinfo=timezone.utc).timestamp() * 1000)


@pytest.mark.parametrize(("text", "start", "end"), [
    ("1851", ms(1851), ms(1852)), ("1852-02", ms(1852, 2), ms(1852, 3)), ("1852-02-29", ms(1852, 2, 29), ms(1852, 3)), ("1899-12-31", ms(1899, 12, 31), ms(1900)), ("18XX", ms(1800), ms(1900)), ("177X", ms(1770), ms(1780)), ("1851-22", ms(1851, 6), ms(1851, 9)), ("1851-23", ms(1851, 9), ms(1851, 12)),
    ("1851?", ms(1851), ms(1852)), ("1851-07%", ms(1851, 7), ms(1851, 8)), ("1790/1801-03", ms(1790), ms(1801, 4)), ("1852-02-28/1852-03-01", ms(1852, 2, 28), ms(1852, 3, 2)), ("1969-12-31T23:59:59Z", ms(1969, 12, 31, 23, 59, 59), ms(1969, 12, 31, 23, 59, 59)), ("1970-01-01T00:30:00-09:30", ms(1970, 1, 1, 10), ms(1970, 1, 1, 10)),
    ("-0044", edtf.days(-44, 1, 1) * edtf.DAY, edtf.days(-43, 1, 1) * edtf.DAY), ("Y-31000", edtf.days(-31000, 1, 1) * edtf.DAY, edtf.days(-30999, 1, 1) * edtf.DAY),
])
def test_spans(text, start, end):
    assert edtf.span(text) == (start, end)


@pytest.mark.parametrize("text", ["18", "spring 1851", "1851-20", "1851-25-01", "1851-7", "18X1", "1851-XX-01", "1852/1851", "1851-02-03T04:05", "1851-02-03T04:60:00Z", "[1851,1852]"])
def test_no_spans(text):
    assert edtf.span(text) is None


def test_civil_days():
    for n in (*range(-800_000, 800_000, 997), 0, 59, 60):
        assert edtf.days(*edtf.civil(n)) == n
    assert edtf.days(1970, 1, 1) == 0 and edtf.days(2000, 3, 1) == 11017


CLAIM = ids.address(b"a claim of the tests")


@pytest.mark.parametrize("document", [
    {"select": {"branch": "$archive"}}, {"select": {"branch": "ships", "head": CLAIM, "claim": CLAIM, "path": [{"dir": "uses", "edges": ["relation/*", "-relation/of"], "min": 0, "max": 4, "nodes": ["source/scan"]}, {"dir": "connections"}]}},
    {"select": {"branch": "b"}, "where": {"not": {"or": [{"field": "tonnage", "test": {"in": ["1", 2, 3.5]}}, {"and": [{"field": "height", "test": {"lt": 9}}, {"field": "name", "test": {"ne": "x"}}]}]}}},
    {"select": {"branch": "b"}, "where": {"field": "dated", "test": {"ge": "185X"}}}, {"select": {"branch": "b"}, "output": {"shape": "single", "detail": "claims", "form": "materialized", "encoding": "json", "content": {"max": 1, "overflow": "omit"}}},
    {"select": {"branch": "b"}, "output": {"detail": "envelope", "form": "original"}}, {"select": {"branch": "b"}, "order": [{"field": "dated", "compare": "temporal"}, {"field": "name", "compare": "lexical", "dir": "asc"}], "limit": {"time": "1m30s"}}, {"select": {"branch": "b"}, "execution": {"report": "trace"}, "limit": {"results": 1}},
])
def test_documents_round_trip(document):
    found = q.decode(json.dumps(document))
    assert q.decode(q.encode(found)) == found


@pytest.mark.parametrize(("change", "error"), [
    ({"select": {}}, errors.NoScope), ({"select": {"branch": "$universe", "claim": CLAIM}}, errors.NoHead), ({"where": {"field": "a", "and": []}}, errors.WhereForm), ({"where": {"not": {"or": []}}}, errors.WhereForm), ({"where": {"test": {"eq": 1}}}, errors.WhereForm),
    ({"where": {"field": "a", "test": {"lt": 1, "gt": 0}}}, errors.ComparisonForm), ({"where": {"field": "a", "test": {"like": "x"}}}, errors.ComparisonForm), ({"where": {"field": "a", "test": {"in": "x"}}}, errors.ComparisonForm),
    ({"select": {"branch": "b", "path": [{"dir": "up"}]}}, errors.Enum), ({"output": {"detail": "all"}}, errors.Enum), ({"order": [{"field": "a", "dir": "up"}]}, errors.Enum), ({"output": {"content": {"max": 3, "overflow": "fold"}}}, errors.Enum), ({"output": {"encoding": "native"}}, errors.Enum), ({"execution": {"report": "error"}}, errors.Enum),
    ({"sort": []}, errors.MalformedQuery), ({"output": {"content": {"min": 1}}}, errors.MalformedQuery), ({"select": {"branch": "b", "claim": "brig"}}, errors.MalformedQuery), ({"limit": {"time": "soon"}}, errors.MalformedQuery), ({"limit": {"results": "9"}}, errors.MalformedQuery), ([], errors.MalformedQuery),
    ({"select": {"branch": "b", "path": [{"min": 5, "max": 4}]}}, errors.Hops), ({"select": {"branch": "b", "path": [{"max": -2}]}}, errors.Bounds), ({"limit": {"results": -1}}, errors.Bounds), ({"output": {"content": {"max": -1}}}, errors.Bounds), ({"output": {"shape": "path"}}, errors.ScanShape), ({"where": {"field": "delete_by", "test": {"lt": "1851"}}}, errors.TimeOperand),
    ({"where": {"field": "dated", "test": {"eq": "someday"}}}, errors.TimeOperand), ({"output": {"detail": "envelope", "form": "materialized"}}, errors.EnvelopeAxis), ({"order": [{"compare": "numeric"}]}, errors.OrderField), ({"execution": {"layer": "  "}}, errors.LayerName),
])
def test_refusals(change, error):
    document = {"select": {"branch": "b"}} | change if isinstance(change, dict) else change
    with pytest.raises(error):
        q.decode(json.dumps(document))
    with pytest.raises(errors.QueryError):
        q.decode("{")


def test_printed_numbers():
    assert [printed(x) for x in (5, 0.1, 1e21, 123456789.0, 1e-5, True, -0.0, 1.5e300)] == ["5", "0.1", "1e+21", "123456789", "1e-05", "true", "-0", "1.5e+300"]


def test_cbor_and_ids(spark):
    for value in (0, 23, 24, -1, -500, 2**40, b"x", "é", [1, [2]], {1: "a", "b": None}, True, 1.5, 1e300, cbor.Tag(18, [b"", {}])):
        assert cbor.decode(cbor.encode(value)) == value
    assert cbor.encode({10: 1, "z": 2, 3: 4}).hex() == "a303040a01617a02" and cbor.sequence(cbor.encode(1) + cbor.encode("a")) == [1, "a"]
    for bad in (b"\x18", b"\x5f", b"\x01\x02", b"\xa2\x01\x01\x01\x01"):
        with pytest.raises(ValueError):
            cbor.decode(bad)
    assert ids.address(b"").startswith("bciq") and ids.text_of(ids.digest_of(ids.address(b"x"))) == ids.address(b"x")
    got_ = ids.addressed(spark.createDataFrame([(b"x",)], "envelope binary"), "envelope").first().address
    assert got_ == ids.address(b"x")


def test_filter_is_total(harbour):
    assert harbour.universe.nodes.where(~filter_of(leaf("tonnage", "lt", "z"))).count() == len(NODES) - 1


def test_budget_of_claims_without_references(harbour):
    rows = budget(harbour.universe.nodes.where("id in ('log', 'lund', 'ada')"), harbour.universe.edges, Content(6, "cutoff")).where("slot = 'node'").collect()
    assert {r.id: r.content and bytes(r.content) for r in rows} == {"log": b"wind f", "lund": b"abcde", "ada": None}
