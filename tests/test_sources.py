"""Stores and streams."""

import json
import threading

from pyspark.sql import functions as F

from claimweave.functions import cbor, ids, wire
from claimweave.model import SCHEMAS, Universe
from claimweave.operators import chunks
from claimweave.sources import contributions, snapshots, stack, store
from claimweave.streaming import ingest


def test_save_and_load(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "source/x")], "id string, type string").selectExpr("*", *(f"cast(null as {k}) {n}" for n, k in (c.strip().split(" ", 1) for c in SCHEMAS["nodes"].split(", ")) if n not in ("id", "type")))
    edges = spark.createDataFrame([], SCHEMAS["edges"])
    store.save(Universe(nodes, edges), str(tmp_path), shards=2)
    back = store.load(spark, str(tmp_path))
    assert [r.id for r in back.nodes.collect()] == ["a"] and back.edges.count() == 0


def test_layers_and_records(spark):
    one, two = (spark.createDataFrame(rows, "id string, v int") for rows in ([("a", 1)], [("a", 2), ("b", 3)]))
    assert sorted(map(tuple, store.layered(one, two).collect())) == [("a", 1), ("b", 3)]
    data = cbor.encode(1) + cbor.encode({"k": [b"x"]})
    rows = store.cbor_records(spark.createDataFrame([("p", data), ("q", b"")], "path string, content binary")).orderBy("position").collect()
    assert [cbor.decode(bytes(r.record)) for r in rows] == [1, {"k": [b"x"]}]


def test_stream_appends_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    claim = lambda i: json.dumps({"id": i, "type": "source/x", "created_at": "2026-01-01T00:00:00.000000000Z"})
    for name, ids in (("one", "ab"), ("two", "bc")):
        (tmp_path / "in" / f"{name}.json").write_text("\n".join(map(claim, ids)))
        ingest.append(ingest.json_claims(spark, str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["a", "b", "c"]
    counted = ingest.arrivals(ingest.json_claims(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("arrivals").outputMode("complete").trigger(availableNow=True).start()
    counted.awaitTermination()
    assert spark.table("arrivals").agg(F.sum("n")).first()[0] == 3


def test_contribution_streams(spark, tmp_path):
    """Streams as files: what good ones bring, where others end, and a commit of what was taken."""
    node = lambda name, height: {"type": "contribution/contributor" if name == "eve" else "source/x", "type_class": "contribution" if name == "eve" else "source", "type_sub": "contributor" if name == "eve" else "x", "created_at": "2026-01-01T00:00:00.000000000Z", "height": height, "fields": {"name": name}}
    edge = lambda dst: {"type": "derivation/x", "type_class": "derivation", "type_sub": "x", "reference": dst, "fields": {}, "relation_direction": 0}
    eve = wire.encode_claim(node("eve", 0), [])
    low = wire.encode_claim(node("low", 0), [])
    high = wire.encode_claim(node("high", 1), [edge(ids.address(low))])
    head, claim, content = contributions.declaring(["main", "side"], ["$archive"]), contributions.claim_record, contributions.content_record
    good = head + claim(low, "main") + claim(high, "main") + content(b"body") + content(b"")
    streams = {
        "good": good, "more": contributions.declaring(["side"], ["$archive"]) + claim(eve, "side") + claim(low, "side") + content(b"body"), "empty": b"", "declared": head,
        "cut": good[:-3], "late": good + head, "bare": claim(low, "main"), "half": cbor.encode([wire.BRANCHES, ["main"]]) + claim(low, "main"), "other": head + claim(low, "third"), "kind": head + cbor.encode([9, b"x", b"y"]), "list": head + cbor.encode({1: 2}),
        "spoiled": head + content(b"body")[:-1] + b"z", "short": head + cbor.encode([wire.CLAIM, b"x"]), "junk": head + cbor.encode([wire.CLAIM, wire.id_bytes(ids.address(b"j")), b"j", "main"]), "unbranched": head + claim(low, "main")[:1].replace(b"\x84", b"\x83") + claim(low, "main")[1:-5], "undeclared list": cbor.encode([wire.BRANCHES, "main"]),
    }
    (tmp_path / "in").mkdir()
    for name, data in streams.items():
        (tmp_path / "in" / name).write_bytes(data)
    got = contributions.open_streams(spark, f"{tmp_path}/in")
    faults = {r.path.rsplit("/", 1)[1].replace("%20", " "): r.fault for r in got.faults.collect()}
    assert faults == {
        "cut": "not a CBOR sequence", "late": "a declaration after the payload", "bare": "no declarations", "half": "no declarations", "other": "a branch that is not declared", "kind": "kind 9", "list": "a record is a list that begins with its kind", "spoiled": "other bytes than the address names",
        "short": "a record without its parts", "junk": "not a claim's record", "unbranched": "a claim without a branch", "undeclared list": "a declaration without its list",
    }
    assert {r.fields["name"] for r in got.nodes().collect()} == {"eve", "low", "high"} and got.nodes().count() == 3 and got.edges().count() == 1
    assert {bytes(r.bytes) for r in got.contents().collect()} == {b"body", b""}
    assert {tuple(r) for r in got.heads().collect()} == {("main", ids.address(high)), ("side", ids.address(eve))}
    assert {(r.path.rsplit("/", 1)[1], r.name, tuple(r.names)) for r in got.declarations().collect()} == {("good", "branches", ("main", "side")), ("good", "referencable", ("$archive",)), ("more", "branches", ("side",)), ("more", "referencable", ("$archive",))}
    store_ = snapshots.Store(spark, f"{tmp_path}/archive")
    last = store_.commit([got.contribution()], ids.address(eve), "2027-01-01T00:00:00.000000000Z")
    assert {r.name: r.head for r in store_.universe().branches.where(F.col("table_id") == last.head).collect()} == {"main": ids.address(high), "side": ids.address(eve)}
    assert contributions.taken(spark.createDataFrame([], "path string, content binary")).nodes().count() == 0


def test_a_stack_fills_its_upper_tier(spark, tmp_path):
    """The first read fetches and fills, the second one touches the upper tier only; concurrent reads fill the same rows, which a read takes once."""
    rows, asked = spark.createDataFrame([(f"r{k}", k) for k in range(20)], "id string, v int"), []

    def lower(ids_):
        asked.append(sorted(r.id for r in ids_.collect()))
        return rows.join(ids_, "id", "left_semi")

    ask = lambda *names: spark.createDataFrame([(n,) for n in names], "id string")
    stack_ = stack.Stack(spark, f"{tmp_path}/upper", "id string, v int", lower)
    assert stack_.upper().count() == 0 and sorted(map(tuple, stack_.get(ask("r1", "r2", "gone", "r1")).collect())) == [("r1", 1), ("r2", 2)]
    stack_.settle()
    assert sorted(map(tuple, stack_.get(ask("r1", "r2")).collect())) == [("r1", 1), ("r2", 2)] and asked == [["gone", "r1", "r2"]]
    assert sorted(r.id for r in stack_.get(ask("r2", "r3")).collect()) == ["r2", "r3"] and asked[1:] == [["r3"]]
    stack_.settle()
    readers = [threading.Thread(target=lambda: stack.Stack(spark, f"{tmp_path}/upper", "id string, v int", lower).get(ask("r7", "r8")).collect()) for _ in range(2)]
    [t.start() for t in readers], [t.join() for t in readers]
    again = stack.Stack(spark, f"{tmp_path}/upper", "id string, v int", lower)
    again.compact()
    n = len(asked)
    assert {r.id for r in again.upper().collect()} >= {"r1", "r2", "r3"} and again.upper().count() == again.upper().select("id").distinct().count()
    assert sorted(r.id for r in again.get(ask("r1", "r3")).collect()) == ["r1", "r3"] and len(asked) == n
    (tmp_path / "upper" / "fill-half").mkdir()
    (tmp_path / "upper" / "fill-half" / "part-0.parquet").write_bytes(b"half")  # a fill that broke off
    assert again.upper().count() >= 3
    assert [r.id for r in stack.healed(rows.where("v > 5"), rows, ask("r1", "r9", "gone")).collect()] == ["r1"]


def test_contents_in_chunks(spark):
    bodies = [b"", b"a", b"ab" * 50, bytes(range(256)) * 3]
    whole = spark.createDataFrame([(ids.address(b), b) for b in bodies], SCHEMAS["contents"])
    parts = chunks.chunked(whole, 100)
    assert {(r.hash, r.position, len(r.bytes)) for r in parts.collect()} == {(ids.address(b), k, len(b[100 * k : 100 * k + 100])) for b in bodies for k in range(max(1, -(-len(b) // 100)))}
    stated = spark.createDataFrame([(ids.address(b), len(b)) for b in bodies] + [(ids.address(b"far"), None)], "hash string, size long")
    assert [tuple(r) for r in chunks.faults(parts, stated).collect()] == [(ids.address(b"far"), "not stored")]
    long, only = ids.address(bodies[3]), stated.where(F.col("size") == 768)
    rest = parts.where((F.col("hash") == long) & (F.col("position") > 1))
    first = {r.position: bytes(r.bytes) for r in parts.where(F.col("hash") == long).collect()}
    put = lambda *rows: rest.unionByName(spark.createDataFrame([(long, k, b) for k, b in rows], SCHEMAS["chunks"]))
    fault = lambda *rows: [r.fault for r in chunks.faults(put(*rows), only).collect()]
    assert fault((0, first[0]), (1, first[1])) == [] and fault((0, first[1]), (1, first[0])) == ["other bytes"]
    assert fault((0, first[0])) == ["chunk 1 is missing"] and fault((1, first[1])) == ["chunk 0 is missing"] and fault((0, first[0]), (1, first[1]), (1, first[1])) == ["chunk 1 stands twice"]
    assert fault((0, first[0]), (1, first[1][:-1])) == ["767 bytes instead of 768"]
