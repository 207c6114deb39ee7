"""Tables of a provenance graph. A claim is a node and its references to older claims (edges)."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.operators.kinds import Kinds

#: Closed sets of classes; subtypes are open.
NODE_CLASSES = ("contribution", "source", "derivation", "entity", "relation")
EDGE_CLASSES = ("contribution", "derivation", "relation")
#: Types that may not carry a planned deletion.
STRUCTURAL = ("contribution/contributor", "contribution/branches", "contribution/head", "contribution/delete")
#: Optional fields that hold an instant.
TIME_FIELDS = ("delete_by", "pubkey_valid_from", "pubkey_expires_after")
SUBTYPE = r"\A[a-z0-9][a-z0-9_]*\z"
INLINE_CAP = 1 << 20

SCHEMAS = {
    "nodes": "id string, type string, type_class string, type_sub string, encoding string, content binary, content_hash string, content_size long, created_at string, created_at_ns long, dated string, dated_mid_ms long, height long, fields map<string,string>, contributor string",
    "edges": "src string, edge_id string, ord int, dst string, type string, type_class string, type_sub string, relation_direction tinyint, encoding string, content binary, content_hash string, content_size long, fields map<string,string>",
    "contents": "hash string, bytes binary",
    "chunks": "hash string, position long, bytes binary",
    "tags": "id string, key string, value string",
    "spine": "id string, revision int, height long, created_at string",
    "branches": "table_id string, name string, head string",
    "bookmarks": "list string, idx long, head string, signer string, slot string",
    "raw": "id string, envelope binary",
}


def columns_of(table: str) -> list[str]:
    return [c.split()[0] for c in SCHEMAS[table].split(", ")]


@dataclass(frozen=True)
class Universe:
    """The tables of one store. `nodes` and `edges` are effective (overlays resolved), the deltas as written.

    max_height bounds every walk along references, so that plans need no action between levels; None makes walks loop.
    """

    nodes: DataFrame
    edges: DataFrame
    nodes_delta: DataFrame | None = None
    edges_delta: DataFrame | None = None
    contents: DataFrame | None = None
    tags: DataFrame | None = None
    spine: DataFrame | None = None
    branches: DataFrame | None = None
    bookmarks: DataFrame | None = None
    raw: DataFrame | None = None
    max_height: int | None = None
    chunks: DataFrame | None = None  # (hash, position, bytes): contents in chunks
    bands: object | None = None  # references by height (operators.bands.Bands), by which closures are swept
    reverse: DataFrame | None = None  # the references again, laid out by dst
    dangling: DataFrame | None = None  # (dst): what is referenced but not stored; found when it is first needed. With a column kind, the type of the claim that references it
    nested: dict[str, DataFrame] | None = None  # by type, nodes with `edges`, references as engine.records() lists them: types whose rows make all of their references
    kinds: Kinds | None = None  # what ids tell of claims, as long as neither ids nor types change

    def with_(self, **changes) -> Universe:
        if {"nodes", "edges"} & changes.keys():
            changes = {"dangling": None, "bands": None, "nested": None, "kinds": None} | changes
        if "edges" in changes:
            changes = {"reverse": None} | changes
        return replace(self, **changes)

    def gaps(self) -> DataFrame:
        """(dst): ids that are referenced but not stored."""
        return self.edges.select("dst").distinct().join(self.nodes.select(F.col("id").alias("dst")), "dst", "left_anti")


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])
