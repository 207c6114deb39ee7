"""Contribution streams as tables: a CBOR sequence that declares what it may touch, then brings claims and contents.

Each stream is one row (path, content) and is read in one pass with a small state: what it has declared so far, and its position. Records leave one at a time, in batches of bounded
size; streams are read in parallel. A stream ends at its first fault, which is a row of its own, and nothing of a stream with a fault is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions import cbor, ids, wire
from claimweave.operators.merge import heads_of
from claimweave.sources.snapshots import Contribution
from claimweave.storage import stored

#: Bytes of payload in a batch.
BATCH = 4 << 20
SHAPE = "path string, position long, kind int, key string, payload binary, branch string, names array<string>, fault string"
TYPES = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.string(), pa.list_(pa.string()), pa.string()]


class Refused(Exception):
    """Why a stream ends before its end."""


def _list(record: list[Any]) -> list[str]:
    if len(record) < 2 or not isinstance(record[1], list) or not all(isinstance(x, str) for x in record[1]):
        raise Refused("a declaration without its list")
    return record[1]


def _payload(record: list[Any], declared: dict[str, list[str]]) -> tuple[str, bytes, str | None]:
    kind = record[0]
    if kind not in (wire.CLAIM, wire.CONTENT):
        raise Refused(f"kind {kind}")
    if len(record) < 3 or not isinstance(record[1], bytes) or not isinstance(record[2], bytes):
        raise Refused("a record without its parts")
    try:
        key = ids.text_of(record[1][2:]) if record[1][:2] == ids.MULTIHASH and len(record[1]) == 34 else record[1].decode()
    except UnicodeDecodeError as wrong:
        raise Refused("a record without its parts") from wrong
    if kind == wire.CLAIM:
        branch = record[3] if len(record) > 3 else None
        if not isinstance(branch, str) or not branch:
            raise Refused("a claim without a branch")
        if branch not in declared["branches"]:
            raise Refused("a branch that is not declared")
        try:
            wire.decode_claim(record[2])
        except (ValueError, TypeError, KeyError, AttributeError) as wrong:
            raise Refused("not a claim's record") from wrong
    else:
        branch = None
    if ids.address(record[2]) != key:
        raise Refused("other bytes than the address names")
    return key, record[2], branch


def _records(path: str, content: bytes) -> Iterator[tuple]:
    declared: dict[str, list[str]] = {}
    at, position, begun = 0, 0, False
    try:
        while at < len(content):
            try:
                record, at = cbor.read(content, at)
            except (ValueError, IndexError, TypeError) as wrong:
                raise Refused("not a CBOR sequence") from wrong
            if not isinstance(record, list) or not record or not isinstance(record[0], int):
                raise Refused("a record is a list that begins with its kind")
            if record[0] in wire.DECLARATIONS:
                if begun:
                    raise Refused("a declaration after the payload")
                name, own = wire.DECLARATIONS[record[0]], _list(record)
                declared[name] = wire.narrowed(name, declared[name], own) if name in declared else own
            else:
                if not begun and not {"branches", "referencable"} <= declared.keys():
                    raise Refused("no declarations")
                if not begun:
                    for name, own in declared.items():
                        yield path, position, next(k for k, v in wire.DECLARATIONS.items() if v == name), name, None, None, own, None
                begun = True
                key, payload, branch = _payload(record, declared)
                yield path, position, record[0], key, payload, branch, None, None
            position += 1
        if not begun and declared and not {"branches", "referencable"} <= declared.keys():
            raise Refused("no declarations")
    except Refused as fault:
        yield path, position, None, None, None, None, None, str(fault)


def records(files: DataFrame) -> DataFrame:
    """The records of streams (path, content): declarations once they are complete, claims, contents, and the fault where one ends a stream."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SHAPE.split(", ")]
        made = lambda held: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), TYPES, strict=True)], names=names)
        for batch in batches:
            for k in range(batch.num_rows):
                held, size = [], 0
                for row in _records(batch.column(0)[k].as_py(), batch.column(1)[k].as_py() or b""):
                    held.append(row)
                    size += len(row[4] or b"") + 200
                    if size >= BATCH:
                        yield made(held)
                        held, size = [], 0
                if held:
                    yield made(held)

    return files.select("path", "content").mapInArrow(read, SHAPE)


@dataclass(frozen=True)
class Streams:
    """What streams brought. faults: (path, position, fault); rows are those of streams without one."""

    rows: DataFrame
    faults: DataFrame

    def claims(self) -> DataFrame:
        return self.rows.where(F.col("kind") == wire.CLAIM)

    def nodes(self) -> DataFrame:
        """Each claim once, however many streams bring it."""
        return wire.nodes_of(self.claims().select("payload")).dropDuplicates(["id"])

    def edges(self) -> DataFrame:
        return wire.edges_of(self.claims().select("payload")).dropDuplicates(["src", "ord"])

    def contents(self) -> DataFrame:
        return self.rows.where(F.col("kind") == wire.CONTENT).select(F.col("key").alias("hash"), F.col("payload").alias("bytes")).dropDuplicates(["hash"])

    def declarations(self) -> DataFrame:
        """(path, name, names) of streams that have a payload."""
        return self.rows.where(F.col("kind") > wire.CONTENT).select("path", F.col("key").alias("name"), "names")

    def heads(self) -> DataFrame:
        """(name, id): the claims of a branch that no other claim brought references."""
        open_ = heads_of(self.nodes(), self.edges())
        return self.claims().select(F.col("branch").alias("name"), F.col("key").alias("id")).distinct().join(open_, "id", "left_semi").select("name", "id")

    def contribution(self) -> Contribution:
        """All that was taken, as Store.commit() wants it."""
        from claimweave.operators.merge import _filled
        from claimweave.plans.predicate import nanoseconds

        nodes = _filled(self.nodes().withColumn("created_at_ns", nanoseconds(F.col("created_at"))), "nodes")
        return Contribution(nodes, _filled(self.edges(), "edges"), self.heads(), self.contents())


def taken(files: DataFrame) -> Streams:
    """Streams (path, content) read once; those with a fault are left out."""
    every = stored(records(files))
    faults = every.where("fault is not null").select("path", "position", "fault")
    return Streams(every.where("fault is null").join(faults.select("path"), "path", "left_anti"), faults)


def open_streams(spark: SparkSession, path: str) -> Streams:
    """The streams in a folder, one for each file."""
    return taken(spark.read.format("binaryFile").load(path).select("path", "content"))


def declaring(branches: list[str], referencable: list[str]) -> bytes:
    """The head of a stream."""
    return cbor.encode([wire.BRANCHES, branches]) + cbor.encode([wire.REFERENCABLE, referencable])


def claim_record(record: bytes, branch: str) -> bytes:
    return cbor.encode([wire.CLAIM, wire.id_bytes(ids.address(record)), record, branch])


def content_record(content: bytes) -> bytes:
    return cbor.encode([wire.CONTENT, wire.id_bytes(ids.address(content)), content])
