"""SQLite files and HTTP services as stores of blobs."""

import sqlite3
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from claimweave.sources import blobstores, rest, stack


def blobs(spark, **rows):
    return spark.createDataFrame([(k, v) for k, v in rows.items()], blobstores.SCHEMA)


def content(df):
    return {r.id: bytes(r.data) for r in df.collect()}


@pytest.fixture
def store(spark, tmp_path):
    """Two hundred blobs in four ranges, then one commit over some of them."""
    path = f"{tmp_path}/store"
    blobstores.save(spark.range(200).selectExpr("format_string('%03d', id) id", "encode(repeat('x', cast(id as int)), 'UTF-8') data"), path, 4)
    blobstores.save(blobs(spark, **{"007": b"new", "150": b"", "200": b"last"}), path, 1)
    return path


def expected():
    return {f"{k:03d}": b"x" * k for k in range(200)} | {"007": b"new", "150": b"", "200": b"last"}


def test_round_trip_in_ranges(spark, store, monkeypatch):
    assert content(blobstores.open_blobs(spark, store)) == expected()
    files = blobstores._files(store)
    assert len(files) == 5 and [f[4] for f in files] == [True] * 5
    monkeypatch.setattr(blobstores, "RANGE", 1)
    ranges = blobstores._Reader(store).partitions()
    assert len(ranges) == 5
    # each id lies in one range, whatever the number of files that hold it
    rows = [id_ for r in ranges for b in blobstores._Reader(store).read(r) for id_ in b.column("id").to_pylist()]
    assert sorted(rows) == sorted(expected())


def test_ids_reach_the_files(spark, store):
    df = blobstores.open_blobs(spark, store)
    cases = {"id = '007'": ["007"], "id in ('150', '003', 'none')": ["003", "150"], "id >= '198'": ["198", "199", "200"], "id > '198' and id <= '199'": ["199"], "id < '001'": ["000"], "id = 'zzz'": [], "id in ('001', '002') and id > '001'": ["002"], "id > '2' and id < '1'": [], "id = '001' and length(data) = 9": [], "id is null": [], "id like '19%' and id <> '190'": [f"{k}" for k in range(191, 200)]}
    for test, ids in cases.items():
        assert content(df.where(test)) == {i: expected()[i] for i in ids}, test
    reader = blobstores._Reader(store)
    left = list(reader.pushFilters([blobstores.In(("id",), ("007", "150", None)), blobstores.EqualTo(("data",), b"")]))
    assert [type(f).__name__ for f in left] == ["EqualTo"] and reader.ids == {"007", "150"}
    plan = df.where("id = '007'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0], plan
    assert content(blobstores.looked_up(blobs(spark, **{"007": None, "150": None, "no": None}).union(blobs(spark, **{"007": None})), store)) == {"007": b"new", "150": b""}


def test_one_file_of_another_program(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/own file.db"
    with sqlite3.connect(path) as db:
        db.execute(blobstores.TABLE)
        db.executemany("INSERT INTO blobs VALUES (?, ?)", [(f"{k * 7919 % 1000:04d}", bytes([k % 256])) for k in range(1000)])
    want = {f"{k * 7919 % 1000:04d}": bytes([k % 256]) for k in range(1000)}
    assert content(blobstores.open_blobs(spark, path)) == want
    assert content(blobstores.open_blobs(spark, path).where("id in ('0500', '1')")) == {"0500": want["0500"]}
    monkeypatch.setattr(blobstores, "RANGE", 4096)
    ranges = blobstores._Reader(path).partitions()
    rows = [id_ for r in ranges for b in blobstores._Reader(path).read(r) for id_ in b.column("id").to_pylist()]
    assert len(ranges) > 3 and sorted(rows) == sorted(want)
    monkeypatch.setattr(blobstores, "BATCH", 3)
    assert sum(b.num_rows for r in ranges for b in blobstores._Reader(path).read(r)) == 1000


def test_only_commits_count(spark, store, tmp_path, monkeypatch):
    writer = blobstores._Writer(store, False)
    monkeypatch.setattr(blobstores, "FILE", 4)
    batch = next(iter(blobstores._batches([("a", b"12"), ("b", b"34"), ("c", b"5"), ("d", b"long one")])))
    lost = writer.write([batch])  # a task whose result never arrived
    assert len(lost.files) == 3 and content(blobstores.open_blobs(spark, store)) == expected()
    writer.abort([lost, None])
    assert not list((tmp_path / "store").glob(lost.files[0][0]))
    writer.commit([writer.write([batch]), None, writer.write([])])
    assert content(blobstores.open_blobs(spark, store)) == expected() | {"a": b"12", "b": b"34", "c": b"5", "d": b"long one"}
    # a task that fails leaves the store as it was
    with pytest.raises(Exception, match="needs an id"):
        blobstores.save(spark.createDataFrame([("x", b"1"), ("y", None)], blobstores.SCHEMA), store)
    assert "x" not in content(blobstores.open_blobs(spark, store))
    blobstores.save(blobs(spark, only=b"this"), store, mode="overwrite")
    assert content(blobstores.open_blobs(spark, store)) == {"only": b"this"}
    assert content(blobstores.open_blobs(spark, store).where("id = '007'")) == {}
    blobstores.save(blobs(spark, only=b"this").where("false"), f"{tmp_path}/none")
    assert content(blobstores.open_blobs(spark, f"{tmp_path}/none")) == {}
    with pytest.raises(Exception, match="FileNotFound"):
        blobstores.open_blobs(spark, f"{tmp_path}/nowhere").collect()


def test_copies_travel_once_a_task(spark, tmp_path, monkeypatch):
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', cast(id % 500 as string)) id", "encode(if(id % 3 = 0, 'hot', cast(id % 500 as string)), 'UTF-8') data").repartition(3)
    sent = rows.mapInArrow(blobstores._thinned, blobstores.SCHEMA)
    assert sent.where("id = 'hot'").count() == 3 and sent.count() <= 3 * 501
    for name, lately in (("wide", 1 << 16), ("narrow", 2)):
        monkeypatch.setattr(blobstores, "LATELY", lately)
        monkeypatch.setattr(blobstores, "FILE", 300)
        blobstores.save(rows, f"{tmp_path}/{name}", 2)
        got = blobstores.open_blobs(spark, f"{tmp_path}/{name}").collect()
        assert len(got) == 501 and all(r.id.encode() == bytes(r.data) for r in got)


@pytest.fixture
def service():
    """A service of blobs that fails once in a while."""
    held, asked = {}, []

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def reply(self, status, body=b""):
            self.send_response(status)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            if self.command != "HEAD":
                self.wfile.write(body)

        def run(self):
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            asked.append((self.command, self.path))
            if len(asked) % 7 == 3:
                return self.reply(503)
            if len(asked) % 11 == 5:
                self.close_connection = True  # no answer at all
                return None
            if self.path.endswith("/forbidden"):
                return self.reply(403)
            if self.command == "PUT":
                held[self.path] = body
                return self.reply(201)
            if self.command == "DELETE":
                return self.reply(204 if held.pop(self.path, None) is not None else 404)
            return self.reply(200, held[self.path]) if self.path in held else self.reply(404)

        do_GET = do_PUT = do_HEAD = do_DELETE = run

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1", held, asked
    server.shutdown()


def test_service(spark, service):
    url, held, asked = service
    own = {f"id {k}/é": f"blob {k}".encode() * k for k in range(40)}
    rows = blobs(spark, **own)
    assert rest.put(rows.union(rows).repartition(3), url) == 40 and len(held) == 40
    ids = rows.select("id").union(spark.createDataFrame([("absent",), (None,)], "id string"))
    assert content(rest.fetched(ids, url)) == own
    assert {r.id: r.held for r in rest.present(ids, url).collect()} == dict.fromkeys(own, True) | {"absent": False}
    assert rest.removed(ids.limit(10).union(spark.createDataFrame([("absent",)], "id string")), url) == 11 and len(held) == 30
    with pytest.raises(Exception, match="403"):
        rest.fetched(spark.createDataFrame([("forbidden",)], "id string"), url).collect()
    with pytest.raises(Exception, match="needs an id"):
        rest.put(spark.createDataFrame([(None, b"1")], blobstores.SCHEMA), url)
    assert rest.put(rows.where("false"), url) == 0


def test_service_below_a_folder(spark, service, tmp_path):
    """A stack: what a read fetches from the service is read from the folder the next time."""
    url, _, asked = service
    rows = blobs(spark, a=b"1", b=b"2", c=b"3")
    rest.put(rows, url)
    tiers = stack.Stack(spark, f"{tmp_path}/upper", blobstores.SCHEMA, lambda ids: rest.fetched(ids, url))
    wanted = rows.select("id").where("id <> 'c'")
    assert content(tiers.get(wanted)) == {"a": b"1", "b": b"2"}
    tiers.settle()
    before = len(asked)
    assert content(tiers.get(wanted)) == {"a": b"1", "b": b"2"} and len(asked) == before
    assert content(tiers.get(rows.select("id"))) == {"a": b"1", "b": b"2", "c": b"3"} and len(asked) > before
    tiers.settle()
