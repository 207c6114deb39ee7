"""The write path: open heads consolidated, contributions folded into branches, and the next branch table."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.errors import Inadmissible
from claimweave.functions import wire
from claimweave.functions.ids import address
from claimweave.model import SCHEMAS, Universe
from claimweave.operators.kinds import met, rows as rows_of
from claimweave.operators.membership import reaching
from claimweave.operators.sync import open_heads
from claimweave.plans.predicate import nanoseconds
from claimweave.storage import stored


@dataclass(frozen=True)
class Minted:
    """A universe with claims more, and the id of the last one; new_nodes and new_edges are what was added (None: nothing)."""

    universe: Universe
    id: str | None
    new_nodes: DataFrame | None = None
    new_edges: DataFrame | None = None


def _filled(rows: DataFrame, table: str) -> DataFrame:
    """rows with every column of the table, absent ones null."""
    for column in SCHEMAS[table].split(", "):
        name, kind = column.split(" ", 1)
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    return rows


def _record(type_: str, height: int, created_at: str, fields: dict[str, str], links: list[tuple[str, str, str | None]]) -> tuple[str, list[dict]]:
    """The id of a structural claim and its references in the byte order of their own addresses."""
    edges = []
    for kind, dst, name in links:
        klass, sub = kind.split("/")
        edges.append({"type": kind, "type_class": klass, "type_sub": sub, "reference": dst, "fields": {"name": name} if name is not None else {}, "relation_direction": 0})
    for e in edges:
        e["edge_id"] = address(wire.cbor.encode(wire.record(e, wire.EDGE)))
    edges.sort(key=lambda e: wire.id_bytes(e["edge_id"]))
    klass, sub = type_.split("/")
    return address(wire.encode_claim({"type": type_, "type_class": klass, "type_sub": sub, "created_at": created_at, "height": height, "fields": fields}, edges)), edges


_LINKS = "array<struct<type:string,dst:string,name:string>>"


def minted_all(claims: DataFrame, contributor: str, created_at: str) -> DataFrame:
    """(key, id, type, height, created_at, edges) of structural claims: (key, type, top, links) with the height of the highest claim referenced. A record holds all
    references of its claim, so they come together in its row; different claims are made in different tasks."""
    shape = "key string, id string, type string, height long, created_at string, edges array<struct<edge_id:string,dst:string,type:string,name:string>>"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                links = [("contribution/contributor", contributor, None), *((x["type"], x["dst"], x["name"]) for x in row["links"])]
                id_, edges = _record(row["type"], row["top"] + 1, created_at, {}, links)
                out.append({"key": row["key"], "id": id_, "type": row["type"], "height": row["top"] + 1, "created_at": created_at, "edges": [{"edge_id": e["edge_id"], "dst": e["reference"], "type": e["type"], "name": e["fields"].get("name")} for e in edges]})
            part = pa.struct([(n, pa.string()) for n in ("edge_id", "dst", "type", "name")])
            kinds = [("key", pa.string()), ("id", pa.string()), ("type", pa.string()), ("height", pa.int64()), ("created_at", pa.string()), ("edges", pa.list_(part))]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], k) for n, k in kinds], names=[n for n, _ in kinds])

    return claims.select("key", "type", "top", F.col("links").cast(_LINKS).alias("links")).mapInArrow(make, shape)


def _with(u: Universe, made: DataFrame, contributor: str) -> tuple[Universe, DataFrame, DataFrame]:
    """u with the claims of minted_all() that it does not hold yet, and their nodes and references."""
    kinds = met(u.kinds, made)
    held = rows_of(u.kinds, u.nodes, kinds).select("id").join(made.select("id"), "id", "left_semi")  # the few claims go to the many
    new = stored(made.join(held, "id", "left_anti"))
    classes = lambda rows: rows.withColumn("type_class", F.substring_index("type", "/", 1)).withColumn("type_sub", F.substring_index("type", "/", -1))
    none = F.create_map().cast("map<string,string>")
    nodes = classes(new.select("id", "type", "height", "created_at")).withColumn("fields", none).withColumn("contributor", F.lit(contributor)).withColumn("created_at_ns", nanoseconds(F.col("created_at")))
    edges = new.select(F.col("id").alias("src"), F.posexplode("edges").alias("ord", "e")).select("src", "ord", "e.edge_id", "e.dst", "e.type", "e.name")
    edges = classes(edges).withColumn("fields", F.when(F.col("name").isNotNull(), F.create_map(F.lit("name"), "name")).otherwise(none)).withColumn("relation_direction", F.lit(0).cast("tinyint")).drop("name")
    nodes, edges = _filled(nodes, "nodes").select(*u.nodes.columns), _filled(edges, "edges").select(*u.edges.columns)
    known = u.kinds
    if known is not None:
        cited = new.select("type", F.explode("edges").alias("e")).select("type", F.col("e.type").alias("link"), F.col("e.dst").alias("dst"))
        known = known.with_claims({r.type for r in new.select("type").distinct().collect()}, [(r.type, r.link, met(known, cited.where((F.col("type") == r.type) & (F.col("link") == r.link)), "dst")) for r in cited.select("type", "link").distinct().collect()])
    return u.with_(nodes=u.nodes.unionByName(nodes), edges=u.edges.unionByName(edges), kinds=known), nodes, edges


def _row(u: Universe, id_: str) -> DataFrame:
    return rows_of(u.kinds, u.nodes, None if u.kinds is None else u.kinds.of(id_)).where(F.col("id") == id_)


def _top(u: Universe, ids: DataFrame, contributor: str) -> DataFrame:
    """ids (id, and other columns) with the heights of their claims and of the contributor as `height`, `floor`; an error where one of them is not stored."""
    own = _row(u, contributor).select("height").take(1)
    heights = rows_of(u.kinds, u.nodes, met(u.kinds, ids)).select("id", "height").join(ids.select("id"), "id", "left_semi")  # the few ids go to the many claims
    found = stored(ids.join(heights, "id", "left"))
    gone = found.where("height is null").count() + (not own)
    if gone:
        raise Inadmissible(f"{gone} references to claims that are not stored")
    return found.withColumn("floor", F.lit(own[0].height))


def _joined(heads: DataFrame) -> DataFrame:
    """(key, type, top, links): claims over the heads (key, id, height, floor) of each key."""
    return heads.groupBy("key").agg(F.greatest(F.max("height"), F.max("floor")).alias("top"), F.collect_set("id").alias("ids")).select("key", F.lit("contribution/head").alias("type"), "top", F.transform("ids", lambda i: F.struct(F.lit("contribution/head").alias("type"), i.alias("dst"), F.lit(None).cast("string").alias("name"))).alias("links"))


def consolidated(u: Universe, heads: DataFrame, contributor: str, created_at: str) -> Minted:
    """One head over all: the only one of heads (id) itself, else a new `contribution/head` that cites them all."""
    own = stored(heads.select("id").distinct())
    first = own.take(2)
    if not first:
        raise Inadmissible("nothing to consolidate")
    if len(first) == 1:
        return Minted(u, first[0].id)
    made = stored(minted_all(_joined(_top(u, own.withColumn("key", F.lit("")), contributor)), contributor, created_at))
    new, nodes, edges = _with(u, made, contributor)
    return Minted(new, made.select("id").first().id, nodes, edges)


def _offered(u: Universe, contributed: dict[str, DataFrame] | DataFrame) -> DataFrame:
    if isinstance(contributed, DataFrame):
        return contributed.select("name", "id").distinct()
    out = u.nodes.sparkSession.createDataFrame([], "name string, id string")
    for name, heads in contributed.items():
        out = out.unionByName(heads.select(F.lit(name).alias("name"), "id"))
    return out.distinct()


def merged(u: Universe, head: str | None, contributed: dict[str, DataFrame] | DataFrame, contributor: str, created_at: str) -> Minted:
    """The archive with contributions folded into its branches, and its new head; the old head where nothing is new.

    contributed: (name, id), the new heads of each branch; their claims are in u already. What a branch reaches already is dropped; its old head is
    folded in, so that its closure grows. One search finds for all branches together what they reach, and their heads are made in one pass: jobs do not grow with the
    number of branches. The new table lies over the old one and names only the branches that advance, which come to the driver for its record.
    """
    spark = u.nodes.sparkSession
    held = u.branches.where(F.col("table_id") == head).select("name", "head") if head is not None else spark.createDataFrame([], "name string, head string")
    held, asked = stored(held), stored(_offered(u, contributed))
    pairs = asked.join(held, "name")
    known = pairs.join(reaching(pairs, u.nodes, u.edges, u.kinds), ["id", "head"], "left_semi").select("name", "id")
    fresh = stored(asked.join(known, ["name", "id"], "left_anti"))
    if fresh.isEmpty():
        return Minted(u, head)
    olds = held.join(fresh.select("name"), "name", "left_semi").select("name", F.col("head").alias("id"))
    heads = _top(u, fresh.unionByName(olds).select(F.col("name").alias("key"), "id"), contributor)
    single = heads.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), F.max("height").alias("height"))
    several = heads.join(single.where("n > 1").select("key"), "key", "left_semi")
    made = stored(minted_all(_joined(several), contributor, created_at))
    advanced = made.select("key", "id", "height").unionByName(single.where("n = 1").select("key", "id", "height"))
    u, nodes, edges = _with(u, made, contributor)
    rows = stored(advanced)
    # the table's own record: a reference for each branch that advances, and the table before
    links = rows.select(F.struct(F.lit("contribution/branch").alias("type"), F.col("id").alias("dst"), F.col("key").alias("name")).alias("link"), "height")
    if head is not None:
        links = links.unionByName(_row(u, head).select(F.struct(F.lit("contribution/diff").alias("type"), F.col("id").alias("dst"), F.lit(None).cast("string").alias("name")).alias("link"), "height"))
    floor = _row(u, contributor).select("height").first().height
    table = links.agg(F.greatest(F.max("height"), F.lit(floor)).alias("top"), F.array_sort(F.collect_list("link")).alias("links")).select(F.lit("table").alias("key"), F.lit("contribution/branches").alias("type"), "top", "links")
    table = stored(minted_all(table, contributor, created_at))
    u, more_nodes, more_edges = _with(u, table, contributor)
    new = table.select("id", "height").first()
    lasting = held.join(rows.select(F.col("key").alias("name")), "name", "left_anti").select(F.lit(new.id).alias("table_id"), "name", "head")
    branches = lasting.unionByName(rows.select(F.lit(new.id).alias("table_id"), F.col("key").alias("name"), F.col("id").alias("head")))
    last = u.spine.agg(F.max("revision")).first()[0] if u.spine is not None else None
    spine = spark.createDataFrame([(new.id, (last or 0) + 1, new.height, created_at)], SCHEMAS["spine"])
    u = u.with_(branches=branches if u.branches is None else u.branches.unionByName(branches), spine=spine if u.spine is None else u.spine.unionByName(spine))
    return Minted(u, new.id, nodes.unionByName(more_nodes), edges.unionByName(more_edges))


def heads_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): the claims of a contribution that no other of it references."""
    return open_heads(nodes, edges).select("id")
