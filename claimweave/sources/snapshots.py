"""A persistent archive: snapshots of claim tables in a folder, and optimistic commits.

A snapshot is a manifest, `manifests/<number>.json`: the archive's head, and for each table the folders of data files that make it up. Data files are never changed. A commit
writes its data first and then creates the next manifest, which only one writer can: the file comes to its name in one step, or not at all. Who finds the number taken reads the new
snapshot, folds onto its head, and tries the next one. So a crash before the last step leaves the old snapshot as it was, besides data files that no manifest names.

On a local disk the step is a hard link; on HDFS a rename that refuses to replace. Object stores have neither: give `publish` a conditional put of theirs.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.errors import Conflict, NotFound
from claimweave.model import SCHEMAS, Universe, empty
from claimweave.operators import merge
from claimweave.plans.predicate import nanoseconds
from claimweave.storage import stored

TABLES = ("nodes", "edges", "contents", "branches", "spine")
#: The column that identifies a row of a table, where a store holds each once.
KEYS = {"nodes": "id", "contents": "hash"}


@dataclass(frozen=True)
class Snapshot:
    """Number 0 is the empty archive. folders: for each table those of its data, within the archive's; parent: the head before."""

    number: int
    head: str | None = None
    folders: dict[str, list[str]] = field(default_factory=dict)
    parent: str | None = None


@dataclass(frozen=True)
class Contribution:
    """New claims with their references and contents, and the heads (name, id) that they bring to branches."""

    nodes: DataFrame
    edges: DataFrame
    heads: DataFrame
    contents: DataFrame | None = None


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def created_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its whole text, False where it is there already: of several writers one gets True."""
    jvm = spark.sparkContext._jvm
    place, files = _files(spark, path)
    scheme = files.getUri().getScheme()
    if scheme not in ("file", "hdfs", "viewfs"):
        raise ValueError(f"no atomic creation is known for {scheme}: give a function of your own")
    draft = jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{place.getName()}.{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if scheme == "file":
            java = jvm.java.nio.file
            at = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            java.Files.createLink(at(place), at(draft))
        else:
            kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
            none = spark.sparkContext._gateway.new_array(kinds, 1)
            none[0] = kinds.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, place, none)
    except Exception as refused:
        if "FileAlreadyExists" not in str(refused):
            raise
        return False
    finally:
        if files.exists(draft):
            files.delete(draft, False)
    return True


class Store:
    """An archive in a folder. publish(path, text): creates a file once, False where another writer has."""

    def __init__(self, spark: SparkSession, path: str, publish: Callable[[str, str], bool] | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.publish = publish or (lambda p, text: created_once(spark, p, text))
        place, files = _files(spark, f"{self.path}/manifests")
        files.mkdirs(place)

    def _manifest(self, number: int) -> str:
        return f"{self.path}/manifests/{number:020d}.json"

    def numbers(self) -> list[int]:
        place, files = _files(self.spark, f"{self.path}/manifests")
        names = [s.getPath().getName() for s in files.listStatus(place)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def snapshot(self, number: int | None = None) -> Snapshot:
        """A snapshot by its number, by default the latest."""
        if number is None:
            number = max(self.numbers(), default=0)
        if number == 0:
            return Snapshot(0)
        place, files = _files(self.spark, self._manifest(number))
        if not files.exists(place):
            raise NotFound(f"snapshot {number}")
        stream = files.open(place)
        try:
            return Snapshot(**json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def at(self, head: str) -> Snapshot:
        """The latest snapshot with this head, such as a bookmark names."""
        for number in reversed(self.numbers()):
            if (found := self.snapshot(number)).head == head:
                return found
        raise NotFound(head)

    def read(self, table: str, snapshot: Snapshot) -> DataFrame:
        return self._rows(table, snapshot.folders.get(table, []))

    def _rows(self, table: str, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[table]).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else empty(self.spark, table)

    def universe(self, snapshot: Snapshot | None = None) -> Universe:
        """The claims of a snapshot, by default of the latest."""
        now = self.snapshot() if snapshot is None else snapshot
        return Universe(**{t: self.read(t, now) for t in TABLES})

    def _write(self, table: str, rows: DataFrame) -> str:
        folder = f"data/{table}/{uuid.uuid4().hex}"
        rows.select(*(c.split()[0] for c in SCHEMAS[table].split(", "))).write.parquet(f"{self.path}/{folder}")
        return folder

    def _new(self, table: str, rows: DataFrame, held: DataFrame) -> DataFrame:
        """Rows that the store does not hold yet; of references those of claims that it does not hold."""
        key = KEYS.get(table, "src")
        return rows.join(held.select(F.col(KEYS.get(table, "id")).alias(key)), key, "left_anti")

    def commit(self, contributions: Iterable[Contribution], contributor: str, created_at: str, attempts: int = 20) -> Snapshot:
        """Store contributions and fold their heads into branches, all in one new snapshot; the latest one where nothing is new.

        The contributed data are written once. After a lost race they are written again only where the winner has stored some of the same claims.
        """
        batch = list(contributions)
        union = lambda parts, table: _all([p for p in parts if p is not None], empty(self.spark, table))
        given = {"nodes": union([c.nodes for c in batch], "nodes").dropDuplicates(["id"]), "edges": union([c.edges for c in batch], "edges").dropDuplicates(["src", "ord"]), "contents": union([c.contents for c in batch], "contents").dropDuplicates(["hash"])}
        heads = stored(_all([c.heads.select("name", "id") for c in batch], self.spark.createDataFrame([], "name string, id string")).distinct())
        written: dict[str, str] = {}
        base: Snapshot | None = None
        for _ in range(attempts):
            now = self.snapshot()
            if base is None or self._overlap(base, now, written):
                written = {t: self._write(t, self._new(t, rows, self.read("contents" if t == "contents" else "nodes", now))) for t, rows in given.items()}
            base = now
            u = self.universe(now)
            u = u.with_(**{t: getattr(u, t).unionByName(self._rows(t, [f])) for t, f in written.items()})
            made = merge.merged(u, now.head, heads, contributor, self._not_before(u, now, heads, created_at))
            if made.id == now.head:
                return now  # nothing is new to the branches; claims that no head leads to are not kept
            rows = {"nodes": made.new_nodes, "edges": made.new_edges, "branches": made.universe.branches.where(F.col("table_id") == made.id), "spine": made.universe.spine.where(F.col("id") == made.id)}
            folders = {t: list(now.folders.get(t, [])) for t in TABLES}
            for t, folder in written.items():
                folders[t].append(folder)
            for t, new in rows.items():
                folders[t].append(self._write(t, new))
            then = Snapshot(now.number + 1, made.id, folders, now.head)
            if self.publish(self._manifest(then.number), json.dumps(then.__dict__, sort_keys=True)):
                return then
        raise Conflict(f"other writers were first {attempts} times")

    def _overlap(self, base: Snapshot, now: Snapshot, written: dict[str, str]) -> bool:
        """Whether snapshots since base hold claims or contents that this commit has written too."""
        for table, key in KEYS.items():
            fresh = [f for f in now.folders.get(table, []) if f not in base.folders.get(table, [])]
            if fresh:
                own = self._rows(table, [written[table]]).select(key)
                if not own.join(self._rows(table, fresh).select(key), key, "left_semi").isEmpty():
                    return True
        return False

    def _not_before(self, u: Universe, now: Snapshot, heads: DataFrame, created_at: str) -> str:
        """created_at, or the time of the latest claim that the new ones will reference: no claim is older than what it references."""
        cited = heads.select("id").unionByName(u.branches.where(F.col("table_id") == now.head).select(F.col("head").alias("id"))).unionByName(self.spark.createDataFrame([(now.head,)], "id string"))
        latest = u.nodes.select("id", "created_at", "created_at_ns").join(cited.distinct(), "id", "left_semi").agg(F.max_by("created_at", "created_at_ns").alias("at"), F.max("created_at_ns").alias("ns"))
        later = latest.select("at", (F.col("ns") > nanoseconds(F.lit(created_at))).alias("later")).first()
        return later.at if later.later else created_at

    def compact(self, snapshot: Snapshot | None = None, attempts: int = 20) -> Snapshot:
        """A snapshot with the same rows in one folder for each table: many small commits leave many small files."""
        for _ in range(attempts):
            now = self.snapshot() if snapshot is None else snapshot
            folders = {t: [self._write(t, self.read(t, now))] if len(now.folders.get(t, [])) > 1 else now.folders.get(t, []) for t in TABLES}
            then = Snapshot(now.number + 1, now.head, folders, now.parent)
            if self.publish(self._manifest(then.number), json.dumps(then.__dict__, sort_keys=True)):
                return then
        raise Conflict(f"other writers were first {attempts} times")

    def orphans(self, hours: float = 24.0) -> list[str]:
        """Folders of data that no manifest names and that are older than a running commit can be: what crashes and lost races left."""
        named = {f for n in self.numbers() for own in self.snapshot(n).folders.values() for f in own}
        out = []
        for table in TABLES:
            place, files = _files(self.spark, f"{self.path}/data/{table}")
            if files.exists(place):
                old = [s.getPath().getName() for s in files.listStatus(place) if s.getModificationTime() / 1000 <= time.time() - 3600 * hours]
                out += [f"data/{table}/{name}" for name in old if f"data/{table}/{name}" not in named]
        return out


def _all(parts: list[DataFrame], none: DataFrame) -> DataFrame:
    out = none if not parts else parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
