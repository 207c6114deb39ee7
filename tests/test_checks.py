"""Signatures, checks of claims in the making, verification runs, and the helpers beside them."""

import pytest
from pyspark.sql import functions as F

from claimweave.functions import cbor, ids, media, signatures, wire
from claimweave.model import SCHEMAS, Universe
from claimweave.operators import bookmarks, construct, sync, verification, verify
from claimweave.plans.predicate import by_instant, sort_columns
from claimweave.plans.query import Key
from claimweave.operators.verification import Options

SEED = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")


def test_signatures_of_the_standard():
    """The first two of RFC 8032's examples."""
    assert signatures.public_key(SEED).hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    assert signatures.sign(SEED, b"").hex() == "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"
    second = bytes.fromhex("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb")
    assert signatures.public_key(second).hex() == "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c"
    assert signatures.authentic(signatures.public_key(second), b"\x72", signatures.sign(second, b"\x72"))


def test_false_signatures():
    key, good = signatures.public_key(SEED), signatures.sign(SEED, b"cargo")
    assert signatures.authentic(key, b"cargo", good)
    for k, m, s in ((key, b"Cargo", good), (key, b"cargo", good[:-1]), (key, b"cargo", bytes([good[0] ^ 1]) + good[1:]), (key[:-1], b"cargo", good), (b"\x02" + b"\0" * 31, b"cargo", good)):
        assert not signatures.authentic(k, m, s)
    late = int.from_bytes(good[32:], "little") + signatures.ORDER  # the same point, written a second way
    assert not signatures.authentic(key, b"cargo", good[:32] + late.to_bytes(32, "little"))


def test_envelopes():
    key = signatures.KEY_CODE + signatures.public_key(SEED)
    whole = signatures.sealed(SEED, b"cargo")
    parts = cbor.decode(whole).value
    change = lambda k, v: cbor.encode(cbor.Tag(signatures.SIGN1, [*parts[:k], v, *parts[k + 1 :]]))
    assert signatures.fault(whole, key) is None
    assert signatures.fault(change(2, b"other"), key) == "not the signer's"
    assert signatures.fault(change(2, b""), key) == "no payload"
    assert signatures.fault(change(1, {4: b"k"}), key) == signatures.fault(change(0, cbor.encode({1: -8, 4: b"k"})), key) == signatures.fault(change(0, cbor.encode({1: -7})), key) == "other headers"
    for broken in (None, b"", b"text", whole + b"\0", cbor.encode(parts), change(0, 5), change(0, b"\xff")):
        assert signatures.fault(broken, key) == "not an envelope"
    assert signatures.fault(whole, None) == signatures.fault(whole, b"") == "no key" and signatures.fault(whole, key[2:]) == "not a key of this kind"


def claims(spark, nodes, edges):
    """nodes: id -> (type, height, created_at_ns); edges: (src, dst, type, fields)."""
    rows = [(i, kind, *kind.split("/"), None, None, None, None, None, at, None, None, height, {}, None) for i, (kind, height, at) in nodes.items()]
    links = [(a, chr(97 + k), k, b, kind, *kind.split("/"), 1 if kind.startswith("relation") else 0, None, None, None, None, fields) for k, (a, b, kind, fields) in enumerate(edges)]
    return Universe(spark.createDataFrame(rows, SCHEMAS["nodes"]), spark.createDataFrame(links, SCHEMAS["edges"]))


@pytest.fixture(scope="module")
def mill(spark):
    """A ledger over two bills; one bill cites a receipt that is gone, by a dated reference, and a letter that is gone and marked, the other a map that is simply gone."""
    nodes = {"ledger": ("derivation/ledger", 2, 30), "bill1": ("source/bill", 1, 20), "bill2": ("source/bill", 1, 10), "eve": ("contribution/contributor", 0, 5), "mark": ("contribution/delete", 1, 25)}
    edges = [("ledger", "bill1", "derivation/input", {}), ("ledger", "bill2", "derivation/input", {}), ("ledger", "mark", "derivation/input", {}), ("bill1", "eve", "contribution/contributor", {}), ("bill2", "eve", "contribution/contributor", {}),
        ("bill1", "receipt", "derivation/input", {"delete_by": "2030-01-01T00:00:00Z"}), ("bill1", "letter", "derivation/input", {}), ("bill2", "map", "derivation/input", {}), ("mark", "letter", "contribution/delete", {})]
    return claims(spark, nodes, edges)


def one(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


@pytest.mark.parametrize(("options", "want"), [
    (Options(), {"ledger": 0, "bill1": 1, "bill2": 1, "mark": 1, "eve": 2}),
    (Options(depth=0), {"ledger": 0}),
    (Options(depth=1), {"ledger": 0, "bill1": 1, "bill2": 1, "mark": 1}),
    (Options(most=3), {"ledger": 0, "bill1": 1, "bill2": 1}),
    (Options(since=20), {"ledger": 0, "bill1": 1, "mark": 1}),
])
def test_what_a_run_covers(spark, mill, options, want):
    assert {r.id: r.depth for r in verification.covered(mill, one(spark, "ledger", "ledger"), options).collect()} == want


def test_gaps_of_a_run(spark, mill):
    only = tuple(r.__name__ for r in verify.RULES)
    found = lambda **o: [tuple(r) for r in verification.verified(mill, one(spark, "ledger"), Options(skip=only, **o)).collect()]
    assert found() == [("map", 2, "gap", "not stored")]
    assert found(depth=1) == [] and found(most=2) == [] and found(trusted=one(spark, "bill2")) == [] and found(trusted=one(spark, "map")) == []
    assert set(found(table_heads=True)) == {("map", 2, "gap", "not stored"), ("ledger", 0, "archive_head", "derivation/ledger")}
    assert found(table_heads=True, stop_after=1) == [("ledger", 0, "archive_head", "derivation/ledger")]


def test_first_failures_of_a_run(spark, mill):
    wrong = mill.with_(nodes=mill.nodes.withColumn("height", F.when(F.col("id") == "bill1", 0).otherwise(F.col("height")).cast("long")))
    got = {r.id: r.rule for r in verification.verified(wrong, one(spark, "ledger"), Options(skip=("time_fields",))).collect()}
    assert got["bill1"] == "height" and got["ledger"] == "signer" and got["map"] == "gap" and got["mark"] == "signer" and "bill2" not in got and "eve" not in got
    nothing = verification.verified(mill, one(spark, "ledger").limit(0), Options())
    assert nothing.columns == ["id", "depth", "rule", "detail"] and nothing.count() == 0


def test_signed_claims(spark, mill):
    key = signatures.KEY_CODE + signatures.public_key(SEED)
    held = mill.nodes.withColumn("content", F.when(F.col("id") == "eve", F.lit(key)))
    raw = spark.createDataFrame([("bill1", signatures.sealed(SEED, b"bill1")), ("bill2", signatures.sealed(b"x" * 32, b"bill2")), ("eve", signatures.sealed(SEED, b"eve")), ("mark", None)], "id string, envelope binary")
    want = {("bill2", "not the signer's"), ("mark", "no key")}
    assert {(r.id, r.detail) for r in verify.signatures(mill.with_(nodes=held, raw=raw)).collect()} == want
    outside = mill.nodes.withColumn("content_hash", F.when(F.col("id") == "eve", F.lit("h")))
    stored = mill.with_(nodes=outside, raw=raw, contents=spark.createDataFrame([("h", key)], "hash string, bytes binary"))
    assert {(r.id, r.detail) for r in verify.signatures(stored).collect()} == want


def test_claims_in_the_making(spark):
    wide, long_ = {f"f{k}": "" for k in range(257)}, "n" * 129
    node = lambda i, encoding=None, content=None, hash_=None, fields={}: (i, "source/scan", "source", "scan", encoding, content, hash_, None, None, 1, None, None, 0, fields, None)  # noqa: B006, E731
    nodes = spark.createDataFrame([
        node("good", "application/ld+json", b"", None, {"a_1": "x" * 65536, "n" * 128: ""}), node("bare"), node("twice", "text/plain", b"x", "h"), node("none", None, b"x"), node("alone", "text/plain"), node("form", "text/", b"x"),
        node("class", "texts/plain", b"x"), node("large", "text/plain", b"x" * ((1 << 20) + 1)), node("wide", fields=wide), node("under", fields={"_a": ""}), node("empty", fields={"": ""}), node("long", fields={long_: ""}), node("value", fields={"a": "é" * 32769}),
    ], SCHEMAS["nodes"])
    edge = lambda src, kind, name=None: (src, "e", 0, "good", kind, *kind.split("/"), 0, None, None, None, None, {} if name is None else {"name": name})
    edges = spark.createDataFrame([edge("two", "contribution/contributor"), edge("two", "contribution/contributor"), edge("over", "contribution/diff"), edge("over", "contribution/diff"), edge("over", "derivation/input", "a"), edge("over", "derivation/note", "a"), edge("over", "derivation/input", ""), edge("plain", "derivation/input")], SCHEMAS["edges"])
    got = {(r.id, r.rule) for r in construct.refused(Universe(nodes, edges)).collect()}
    assert got == {("twice", "content_twice"), ("none", "encoding_missing"), ("alone", "encoding_alone"), ("form", "encoding_form"), ("class", "encoding_form"), ("large", "content_inline"), ("wide", "field_count"), ("under", "field_name"), ("empty", "field_name"), ("long", "field_name"), ("value", "field_value"),
        ("two", "single"), ("over", "single"), ("over", "edge_name")}
    assert construct.refused(Universe(nodes.limit(0), edges.limit(0))).count() == 0


@pytest.mark.parametrize("most", [0, 1, 2, 3, 4, 5, 9, 10])
def test_cuts(spark, most):
    texts = [None, "", "abc", "é漢😀x", "😀😀", "漢漢漢", "aé" * 3]
    whole = lambda t: t if t is None else t.encode()[:most].decode(errors="ignore")
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").withColumn("c", media.cut(F.col("t"), most)).orderBy("n").collect()
    assert [r.c for r in rows] == [whole(t) for t in texts]


def test_instants_order_by_time(spark):
    texts = ["2031-05-01T08:00:00Z", "2031-05-01T09:30:00+02:00", "2031-05-01T08:00:00.000000001Z", "1969-12-31T23:59:59.5Z", "harvest", None]
    rows = [(f"{k}", k, 1, 0, None, {} if t is None else {"at": t}) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "id string, created_at_ns long, height long, content_size long, dated string, fields map<string,string>")
    order = lambda **kw: [int(r.id) for r in frame.orderBy(*sort_columns((Key("at", **kw),))).collect()]
    assert order() == [3, 1, 0, 2, 4, 5] and order(dir="desc") == [4, 2, 0, 1, 3, 5]
    assert order(compare="lexical") == sorted(range(5), key=lambda k: texts[k]) + [5]
    shown = spark.createDataFrame([(t,) for t in texts], "t string").select(by_instant(F.col("t")).alias("t")).collect()
    assert [r.t for r in shown] == ["2031-05-01T08:00:00.000000000Z", "2031-05-01T07:30:00.000000000Z", "2031-05-01T08:00:00.000000001Z", "1969-12-31T23:59:59.500000000Z", "harvest", None]


def test_branches_groups_and_bounds(spark, mill):
    names, held = spark.createDataFrame([("main",), ("new",), ("made",)], "name string"), spark.createDataFrame([("main", "h")], "name string, head string")
    refused = lambda *may: {r.name for r in sync.refused_branches(names, held, may).collect()}
    assert refused() == {"new", "made"} and refused("made") == {"new"} and refused("$branches") == set()
    tagged = mill.nodes.withColumn("fields", F.when(F.col("id").startswith("bill"), F.create_map(F.lit("page"), F.lit("7"))).otherwise(F.col("fields")))
    assert {tuple(r) for r in sync.grouped(tagged, "page").collect()} == {("7", "bill1"), ("7", "bill2")}
    assert sync.grouped(tagged, "page", ("derivation/ledger",)).count() == 0
    marks = spark.createDataFrame([("l", 3), ("l", 9), ("k", 0)], "list string, idx long")
    assert {tuple(r) for r in bookmarks.bounds(marks).collect()} == {("l", 3, 9), ("k", 0, 0)}


def keyed(spark, signer_fields, at, expiries=(), own=10):
    """A note of the year `at` signed by eve; expiry references (citing claim, date) name eve; all notes of `own` and root are roots."""
    year = lambda y: (y - 1970) * 365 * 86400 * 10**9
    nodes = {"eve": ("contribution/contributor", 0, year(2020)), "note": ("source/note", 1, year(at)), "root": ("derivation/root", 2, year(2021)), "other": ("derivation/root", 2, year(2021))}
    edges = [("note", "eve", "contribution/contributor", {}), ("root", "note", "derivation/input", {}), *((src, "eve", "contribution/expiry", {"pubkey_expires_after": date}) for src, date in expiries)]
    u = claims(spark, nodes, edges)
    fields = F.when(F.col("id") == "eve", F.create_map(*(F.lit(x) for kv in signer_fields.items() for x in kv))) if signer_fields else F.lit(None)
    return u.with_(nodes=u.nodes.withColumn("fields", F.coalesce(fields, F.create_map()).cast("map<string,string>")))


@pytest.mark.parametrize(("fields", "at", "expiries", "want"), [
    ({}, 2017, [("root", "2001-01-01T00:00:00Z")], ["eve"]),  # the date of the reference counts, not that of the claim that has it
    ({}, 2017, [("root", "2030-01-01T00:00:00Z")], []),
    ({}, 2017, [("other", "2001-01-01T00:00:00Z")], []),  # outside the closure of the roots
    ({}, 2017, [("root", "2030-01-01T00:00:00Z"), ("root", "2001-01-01T00:00:00Z")], ["eve"]),
    ({}, 2017, [("root", "soon")], ["pubkey_expires_after=soon"]),
    ({"pubkey_valid_from": "2030-01-01T00:00:00Z"}, 2031, [], []),  # eve's own claim is older than her key
    ({"pubkey_valid_from": "2030-01-01T00:00:00Z"}, 2017, [], ["eve"]),
    ({"pubkey_expires_after": "2010-01-01T00:00:00Z"}, 2017, [("root", "2030-01-01T00:00:00Z")], ["eve"]),
    ({"pubkey_valid_from": "never"}, 2017, [], ["pubkey_valid_from=never"]),
])
def test_windows_of_keys(spark, fields, at, expiries, want):
    got = verify.key_window(keyed(spark, fields, at, expiries), one(spark, "root")).collect()
    assert [(r.id, r.detail) for r in got] == [("note", w) for w in want]


def test_expiries_of_a_run_count_from_its_roots(spark):
    u = keyed(spark, {}, 2017, [("other", "2001-01-01T00:00:00Z")])
    skip = tuple(r.__name__ for r in verify.RULES if r is not verify.key_window)
    assert verification.verified(u, one(spark, "root"), Options(skip=skip)).count() == 0
    assert [r.id for r in verification.verified(u, one(spark, "root", "other"), Options(skip=skip)).collect()] == ["note"]


def test_addresses_by_built_in_functions(spark):
    values = [b"", b"a", b"\xff" * 100, *(bytes([k, k * 7 % 256]) for k in range(50))]
    frame = spark.createDataFrame([(v,) for v in values], "v binary")
    assert {(bytes(r.v), r.address) for r in ids.addressed(frame, "v").collect()} == {(v, ids.address(v)) for v in values}
    assert ids.addressed(spark.createDataFrame([(None,)], "v binary"), "v").first().address is None


def test_contents_that_the_decoder_reads(spark):
    """Hashes as records have them, of claims and of references, within and outside."""
    node = {"type": "source/note", "type_class": "source", "type_sub": "note", "created_at": "2020-01-01T00:00:00Z", "height": 1, "fields": {}, "encoding": "text/plain", "content_hash": ids.address(b"far"), "content_size": 3}
    edge = {"type": "contribution/contributor", "type_class": "contribution", "type_sub": "contributor", "reference": ids.address(b"eve"), "fields": {}, "relation_direction": 0, "encoding": "text/plain", "content": b"near", "content_hash": ids.address(b"near"), "content_size": 4}
    records = spark.createDataFrame([(wire.encode_claim(node, [edge]),)], "record binary")
    nodes, edges = wire.nodes_of(records), wire.edges_of(records)
    contents = spark.createDataFrame([(ids.address(b"far"), b"far")], SCHEMAS["contents"])
    u = Universe(nodes, edges, contents=contents)
    assert verify.content_integrity(u).count() == 0 and verify.content_encoding(u).count() == 0
    spoiled = u.with_(edges=edges.withColumn("content", F.lit(b"Near")).withColumn("encoding", F.lit(None).cast("string")))
    assert [r.detail for r in verify.content_integrity(spoiled).collect()] == [ids.address(b"near")]
    assert [r.rule for r in verify.content_encoding(spoiled).collect()] == ["encoding"]
    assert [r.detail for r in verify.content_integrity(u.with_(contents=contents.limit(0))).collect()] == [ids.address(b"far")]
    assert verify.content_integrity(u.with_(contents=None)).count() == 0


def test_who_signs(spark):
    nodes = {"a": ("entity/thing", 0, 1), "b": ("source/x", 1, 2), "c": ("source/x", 1, 2), "z": ("contribution/contributor", 0, 0)}
    edges = [("b", "z", "contribution/contributor", {}), ("b", "a", "contribution/contributor", {}), ("c", "a", "derivation/a", {})]
    u = claims(spark, nodes, edges)
    assert {r.id: r.signer for r in verify.signers(u).collect()} == {"a": "a", "b": "z", "c": None, "z": "z"}
    assert [r.id for r in verify.signed(u).collect()] == ["c"]


def test_all_rules_are_one_pass(spark, mill, tmp_path):
    """References are read twice, once for each one's forerunner; and the claims asked for are picked out before anything else."""
    mill.nodes.write.parquet(f"{tmp_path}/nodes")
    mill.edges.write.parquet(f"{tmp_path}/edges")
    u = Universe(spark.read.schema(SCHEMAS["nodes"]).parquet(f"{tmp_path}/nodes"), spark.read.schema(SCHEMAS["edges"]).parquet(f"{tmp_path}/edges"))
    rules = tuple(r for r in verify.RULES if r is not verify.key_window)  # expiries are read besides, by their type
    plan = verify.violations(u, rules=rules)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("relation_direction") >= 1 and sum("Relation" in line and "edge_id" in line for line in plan.splitlines()) == 2
    apart = {tuple(x) for r in rules for x in r(u).collect()}
    assert {tuple(x) for x in verify.violations(u, rules=rules, first_only=False).collect()} == apart
    assert {tuple(x) for x in verify.violations(u, rules=rules, first_only=False, within=one(spark, "ledger")).collect()} == {x for x in apart if x[0] == "ledger"}
    order = {r.__name__: n for n, r in enumerate(rules)}
    named = {verify.LABELS.get(n, n): k for n, k in order.items()}
    firsts = {i: min((named[rule], rule) for j, rule, _ in apart if j == i)[1] for i, _, _ in apart}
    assert {r.id: r.rule for r in verify.violations(u, rules=rules).collect()} == firsts


def test_signatures_in_batches():
    """Many at once as one by one: several signers, forged ones, repeats, points that are none, and pairs whose parts of small order cancel in a sum."""
    seeds = [bytes([k]) * 32 for k in range(3)]
    keys = [signatures.public_key(s) for s in seeds]
    rows = [(keys[k % 3], b"m%d" % k, signatures.sign(seeds[k % 3], b"m%d" % k)) for k in range(40)]
    rows[5] = (keys[1], b"m5", rows[5][2])  # another's
    rows[11] = (rows[11][0], b"else", rows[11][2])
    rows[12] = (rows[12][0], rows[12][1], rows[12][2][:32] + bytes(32))
    rows[13] = (rows[13][0], rows[13][1], b"\xff" * 32 + rows[13][2][32:])
    rows[14] = (b"short", b"", b"")
    rows[15] = rows[16]
    small = (0, signatures.FIELD - 1, 1)  # of order two
    for k in (20, 21):
        scalar, prefix = signatures._secret(seeds[0])
        nonce = signatures._number(prefix, b"n%d" % k) % signatures.ORDER
        first = signatures._bytes(signatures._add(signatures._times(nonce, signatures.BASE), small))
        second = (nonce + signatures._number(first, keys[0], b"n%d" % k) * scalar) % signatures.ORDER
        rows[k] = (keys[0], b"n%d" % k, first + second.to_bytes(32, "little"))
    mixed = signatures._bytes(signatures._add(signatures._point(keys[2]), small))  # a key with a part of small order is checked row by row
    rows[30] = (mixed, rows[30][1], rows[30][2])
    want = [signatures.authentic(*r) for r in rows]
    assert signatures.authentic_all(rows) == want and [k for k, good in enumerate(want) if not good] == [5, 11, 12, 13, 14, 20, 21, 30]
    assert signatures.authentic_all([]) == [] and signatures.authentic_all(rows[:1]) == [True]


def test_a_batch_is_five_times_as_fast():
    import time

    seed = b"a seed of 32 bytes for this test."[:32]
    key = signatures.public_key(seed)
    rows = [(key, b"%d" % k, signatures.sign(seed, b"%d" % k)) for k in range(400)]
    at = time.process_time()
    assert all(signatures.authentic(*r) for r in rows[:40])
    alone, at = (time.process_time() - at) / 40, time.process_time()
    assert all(signatures.authentic_all(rows))
    assert 5 * (time.process_time() - at) / 400 < alone
