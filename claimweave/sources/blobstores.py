"""Blobs by id in SQLite files: one file as other programs write it, or a folder of many that Spark writes and reads in parallel.

Every file holds the table blobs (id TEXT PRIMARY KEY, data BLOB NOT NULL). In a folder each task writes files of its own, under names that are used once; what counts is what a commit lists,
a small file that appears at once when all tasks are done. Files of tasks that were lost, repeated or aborted are in no commit and are never read. Of an id that several commits hold, the
last commit's bytes are read. Ranges of ids are planned from the commits, so a read merges the files that overlap a range, in order, and shuffles nothing; tests of ids reach the files' index.

The commits list each file, so this is a form to exchange archives in, of some thousands of files; the archive at large is `snapshots`.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import json
import sqlite3
import time
import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from claimweave.functions.ids import address_column

NAME = "claim_sqlite"
SCHEMA = "id string, data binary"
TABLE = "CREATE TABLE blobs (id TEXT PRIMARY KEY, data BLOB NOT NULL)"
#: Blobs of some kilobytes leave much of a page of the usual 4 KB empty; any program reads any size of page.
PAGE = "PRAGMA page_size = 32768"
#: Bytes of data in a file, in a range that one task reads, and in a batch.
FILE, RANGE, BATCH = 64 << 20, 64 << 20, 4 << 20
#: Ids in one look-up of a file, and ids sampled for each range of a file that states none.
ASKED, SAMPLED = 500, 20
#: Ids that a task remembers as sent.
LATELY = 1 << 16


@dataclass(frozen=True)
class Written(WriterCommitMessage):
    """Files of one task: name, least and greatest id, bytes."""

    files: tuple


def _placed(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def _opened(path: str, settled: bool) -> sqlite3.Connection:
    """A file to read. settled: nothing writes to it any more, so it needs no locks; one of another file system is read whole."""
    place, name = _placed(path)
    if isinstance(place, fs.LocalFileSystem):
        return sqlite3.connect(f"file:{urllib.parse.quote(name)}?mode=ro{'&immutable=1' if settled else ''}", uri=True)
    with place.open_input_stream(name) as stream:
        data = stream.read()
    out = sqlite3.connect(":memory:")
    out.deserialize(data)
    return out


def _batches(rows: Iterator[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size; a blob above the bound is a batch of its own."""
    ids, data, size = [], [], 0
    for id_, blob in rows:
        if ids and size + len(blob) > BATCH:
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.string()), "data": pa.array(data, pa.binary())})
            ids, data, size = [], [], 0
        ids.append(id_)
        data.append(blob)
        size += len(blob)
    if ids:
        yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.string()), "data": pa.array(data, pa.binary())})


def _files(path: str) -> list[tuple[str, str | None, str | None, int, bool]]:
    """(file, least and greatest id, bytes, settled), the newest commit's first; a file that is no folder is a store of its own and states no ids."""
    place, name = _placed(path)
    info = place.get_file_info(name)
    if info.type == fs.FileType.File:
        return [(path, None, None, info.size, False)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    out = []
    for found in sorted(place.get_file_info(fs.FileSelector(name)), key=lambda f: f.base_name, reverse=True):
        if found.base_name.startswith("commit-"):
            with place.open_input_stream(found.path) as stream:
                commit = json.loads(stream.read())
            out += [(f"{path.rstrip('/')}/{f}", least, greatest, size, True) for f, least, greatest, size in commit["files"]]
            if commit["alone"]:
                break
    return out


def _bounds(files: list) -> list[str]:
    """Least ids of the ranges after the first, in order."""
    if any(least is None for _, least, _, _, _ in files):
        (path, _, _, size, _), *_ = files
        ranges = -(-size // RANGE)
        if ranges <= 1:
            return []
        with _opened(path, False) as db:
            first, last = db.execute("SELECT min(rowid), max(rowid) FROM blobs").fetchone()
            if first is None:
                return []
            step = max((last - first + 1) // (ranges * SAMPLED), 1)
            # addresses do not follow the order of writing, so ids at even distances are a fair sample
            ids = sorted({r[0] for at in range(first, last + 1, step) for r in db.execute("SELECT id FROM blobs WHERE rowid >= ? LIMIT 1", (at,))})
        return [ids[len(ids) * k // ranges] for k in range(1, ranges)] if len(ids) > ranges else ids[1:]
    out, size = [], 0
    for _, least, _, bytes_, _ in sorted(files, key=lambda f: f[1]):
        if size and size + bytes_ > RANGE and (not out or least > out[-1]):
            out.append(least)
            size = 0
        size += bytes_
    return out


def _overlapping(files: list, low: str | None, high: str | None) -> list[tuple[str, bool]]:
    """Those that can hold ids from low on and below high, in the order given."""
    return [(f, settled) for f, least, greatest, _, settled in files if least is None or ((high is None or least < high) and (low is None or greatest >= low))]


def _aged(rows: Iterator[tuple[str, bytes]], age: int) -> Iterator[tuple[str, int, bytes]]:
    return ((id_, age, data) for id_, data in rows)


def _scanned(files: list[tuple[str, bool]], low: str | None, high: str | None) -> Iterator[tuple[str, bytes]]:
    tests = [("id >= ?", low)] * (low is not None) + [("id < ?", high)] * (high is not None)
    where = f"WHERE {' AND '.join(t for t, _ in tests)}" if tests else ""
    dbs = [_opened(f, settled) for f, settled in files]
    try:
        streams = [_aged(db.execute(f"SELECT id, data FROM blobs {where} ORDER BY id", [v for _, v in tests]), age) for age, db in enumerate(dbs)]
        merged = heapq.merge(*streams, key=lambda row: row[:2])
        before = None
        for id_, _, data in merged:
            if id_ != before:
                yield id_, data
            before = id_
    finally:
        for db in dbs:
            db.close()


def _found(files: list[tuple[str, bool]], ids: list[str]) -> Iterator[tuple[str, bytes]]:
    """Rows of the ids, each from the newest file that has it."""
    dbs = [_opened(f, settled) for f, settled in files]
    try:
        for some in itertools.batched(ids, ASKED):
            left = dict.fromkeys(some)
            for db in dbs:
                if left:
                    for id_, data in db.execute(f"SELECT id, data FROM blobs WHERE id IN ({', '.join('?' * len(left))})", list(left)).fetchall():
                        del left[id_]
                        yield id_, data
    finally:
        for db in dbs:
            db.close()


class Blobs(DataSource):
    """`path`: a folder, or one file. Columns id and data. Appends and overwrites commit at once."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.ids, self.low, self.high = path, None, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Sets and ranges of ids; what is left goes back to Spark."""
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if isinstance(f, IsNotNull) and f.attribute in (("id",), ("data",)):
                continue
            if f.__class__ in (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual) and f.attribute == ("id",):
                if values is not None:
                    own = {v for v in values if v is not None}
                    self.ids = own if self.ids is None else self.ids & own
                    continue
                after = f.value + "\0" if isinstance(f, GreaterThan | LessThanOrEqual) else f.value  # the next string
                if isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.low = after if self.low is None else max(self.low, after)
                else:
                    self.high = after if self.high is None else min(self.high, after)
                continue
            yield f

    def partitions(self) -> list[InputPartition]:
        files = _files(self.path)
        edges = [None, *_bounds(files), None] if files else [None]
        ids = None if self.ids is None else sorted(i for i in self.ids if (self.low is None or i >= self.low) and (self.high is None or i < self.high))
        out = []
        for low, high in itertools.pairwise(edges):
            if ids is not None:
                own = ids[0 if low is None else bisect.bisect_left(ids, low) : None if high is None else bisect.bisect_left(ids, high)]
                low, high = (own[0], own[-1] + "\0") if own else (low, low)
            else:
                own = None
                low = low if self.low is None else self.low if low is None else max(low, self.low)
                high = high if self.high is None else self.high if high is None else min(high, self.high)
            if (own is None or own) and (low is None or high is None or low < high) and (held := _overlapping(files, low, high)):
                out.append(InputPartition((held, low, high, own)))
        return out or [InputPartition(([], None, None, None))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        files, low, high, ids = partition.value
        yield from _batches(_scanned(files, low, high) if ids is None else _found(files, ids))


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, alone: bool):
        self.path, self.alone = path.rstrip("/"), alone

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        place, root = _placed(self.path)
        place.create_dir(root, recursive=True)
        files, db, size = [], None, 0

        def close() -> None:
            least, greatest = db.execute("SELECT min(id), max(id) FROM blobs").fetchone()
            db.commit()
            name = f"blobs-{uuid.uuid4().hex}.db"
            with place.open_output_stream(f"{root}/{name}") as out:
                out.write(db.serialize())
            db.close()
            files.append((name, least, greatest, size))

        for batch in batches:
            for id_, data in zip(batch.column("id").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if id_ is None or data is None:
                    raise ValueError("a blob needs an id and its bytes")
                if db is not None and size + len(data) > FILE:
                    close()
                    db = None
                if db is None:
                    db, size = sqlite3.connect(":memory:"), 0
                    db.execute(PAGE)
                    db.execute(TABLE)
                db.execute("INSERT OR REPLACE INTO blobs VALUES (?, ?)", (id_, data))
                size += len(data)
        if db is not None:
            close()
        return Written(tuple(files))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        place, root = _placed(self.path)
        place.create_dir(root, recursive=True)
        name = f"commit-{time.time_ns():020d}-{uuid.uuid4().hex}.json"
        with place.open_output_stream(f"{root}/.{name}") as out:
            out.write(json.dumps({"alone": self.alone, "files": [f for m in messages if m for f in m.files]}).encode())
        place.move(f"{root}/.{name}", f"{root}/{name}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        place, root = _placed(self.path)
        for name, *_ in (f for m in messages if m for f in m.files):
            place.delete_file(f"{root}/{name}")


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Blobs)


def open_blobs(spark: SparkSession, path: str) -> DataFrame:
    """(id, data): each id once. Tests of id (equality, sets, bounds) reach the files."""
    register(spark)
    return spark.read.format(NAME).load(path)


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches without rows whose id the task has sent on lately, so that copies of one id do not all travel; the writer meets what is left of them."""
    lately: dict[str | None, None] = {}
    for batch in batches:
        kept = []
        for at, id_ in enumerate(batch.column("id").to_pylist()):
            if id_ is None or id_ not in lately:
                kept.append(at)
            lately.pop(id_, None)
            lately[id_] = None
            if len(lately) > LATELY:
                del lately[next(iter(lately))]
        yield batch if len(kept) == batch.num_rows else batch.take(pa.array(kept, pa.int64()))


def save(rows: DataFrame, path: str, ranges: int | None = None, mode: str = "append") -> None:
    """Write (id, data) in ranges of ids, as one commit; copies of a row are written once. Rows without an id or without bytes are refused.

    The rows travel once, to their range; of an id that repeats each task sends about one. Of an id with several bytes any may stay.
    """
    register(rows.sparkSession)
    sent = rows.select("id", "data").mapInArrow(_thinned, SCHEMA)
    sent = sent.repartitionByRange(ranges, "id") if ranges else sent.repartitionByRange("id")
    sent.sortWithinPartitions("id").write.format(NAME).mode(mode).save(path)


def looked_up(ids: DataFrame, path: str, ranges: int | None = None) -> DataFrame:
    """(id, data) of the ids of a table that the store holds: each task asks the files that overlap its range of ids."""
    files = _files(path)
    wanted = ids.select("id").where("id is not null").distinct()
    wanted = (wanted.repartitionByRange(ranges, "id") if ranges else wanted.repartitionByRange("id")).sortWithinPartitions("id")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if own := batch.column(0).to_pylist():
                yield from _batches(_found(_overlapping(files, own[0], own[-1] + "\0"), own))

    return wanted.mapInArrow(ask, SCHEMA)


def records_as_blobs(rows: DataFrame) -> DataFrame:
    """(id, data) of claims' records in a column `encoded`: a claim's id is its record's address."""
    return rows.select(address_column(F.col("encoded")).alias("id"), F.col("encoded").alias("data"))
