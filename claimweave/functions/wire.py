"""Claims as records in deterministic CBOR, and the record stream of a contribution."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType

from claimweave import errors
from claimweave.functions import cbor, ids

# Fixed values of the wire form. Keys of a record's slots:
SHARED = {"type_class": 1, "type_sub": 2, "encoding_class": 3, "encoding_sub": 4, "content_hash": 5, "content": 6, "content_size": 7, "fields": 8}
NODE = SHARED | {"created_at": 9, "edges": 10, "height": 11, "dated": 14}
EDGE = SHARED | {"reference": 12, "relation_direction": 13}
# Letters that stand, after a dot, for frequent words:
CLASSES = {"contribution": "c", "source": "s", "derivation": "d", "entity": "e", "relation": "r"}
SUBTYPES = {"contributor": "c", "head": "h", "branches": "B", "branch": "b", "prune": "p", "diff": "d", "delete": "x", "expiry": "e"}
FIELDS = {"name": "n", "edges": "e", "content": "c", "content_size": "s", "content_hash": "h", "height": "H", "edges_diff_omit": "E", "fields_diff_omit": "F", "pubkey_valid_from": "v", "pubkey_expires_after": "x", "delete_by": "d"}
MEDIA = {"application": "a", "audio": "A", "example": "e", "font": "f", "image": "i", "message": "m", "model": "l", "multipart": "M", "text": "t", "video": "V"}
# application, text, image, audio and video, font
MEDIA_SUBTYPES = {
    "json": "j", "ld+json": "J", "xml": "x", "xhtml+xml": "X", "pdf": "p", "octet-stream": "o", "manifest+json": "w", "rtf": "r", "zip": "z", "gzip": "g", "x-tar": "t", "x-bzip2": "b", "x-7z-compressed": "7", "vnd.rar": "R",
    "java-archive": "k", "epub+zip": "e", "msword": "W", "vnd.ms-excel": "E", "vnd.ms-powerpoint": "Y", "vnd.openxmlformats-officedocument.wordprocessingml.document": "d", "vnd.openxmlformats-officedocument.spreadsheetml.sheet": "s",
    "vnd.openxmlformats-officedocument.presentationml.presentation": "P", "vnd.oasis.opendocument.text": "T", "vnd.oasis.opendocument.spreadsheet": "S", "vnd.oasis.opendocument.presentation": "Q",
    "plain": "n", "html": "h", "css": "c", "javascript": "a", "csv": "v", "markdown": "m", "calendar": "l",
    "png": "G", "apng": "A", "jpeg": "i", "gif": "f", "webp": "B", "avif": "V", "svg+xml": "y", "bmp": "M", "tiff": "F", "vnd.microsoft.icon": "I",
    "mpeg": "q", "aac": "C", "wav": "U", "ogg": "O", "webm": "K", "midi": "D", "mp4": "4", "x-msvideo": "Z", "mp2t": "2", "3gpp": "3",
    "woff": "L", "woff2": "H", "ttf": "5", "otf": "6",
}
# Kinds of a contribution's records: a claim, a content, and four declarations.
CLAIM, CONTENT, BRANCHES, REFERENCABLE, LIFTED, CREATABLE = range(6)
DECLARATIONS = {BRANCHES: "branches", REFERENCABLE: "referencable", LIFTED: "lifted", CREATABLE: "creatable"}

_LETTERS = {"type_class": CLASSES, "type_sub": SUBTYPES, "encoding_class": MEDIA, "encoding_sub": MEDIA_SUBTYPES}
_WORDS = {slot: {v: k for k, v in table.items()} for slot, table in (_LETTERS | {"field": FIELDS}).items()}


def _short(table: dict[str, str], word: str) -> str:
    return f".{table[word]}" if word in table else word


def _long(table: dict[str, str], word: str) -> str:
    return table.get(word[1:], word[1:]) if word.startswith(".") else word


def id_bytes(text: str) -> bytes:
    """An id's own bytes; those of its text where it is no content address."""
    try:
        return ids.MULTIHASH + ids.digest_of(text)
    except ValueError:
        return text.encode()


def _id_text(raw: bytes) -> str:
    return ids.text_of(raw[2:]) if raw[:2] == ids.MULTIHASH and len(raw) == 34 else raw.decode()


def record(row: dict[str, Any], keys: dict[str, int]) -> dict[int, Any]:
    parts = dict(zip(("encoding_class", "encoding_sub"), row["encoding"].split("/", 1), strict=False)) if row.get("encoding") else {}
    out: dict[int, Any] = {}
    for slot, key in keys.items():
        value = parts.get(slot) if slot.startswith("encoding_") else row.get(slot)
        if slot in _LETTERS and value is not None:
            value = _short(_LETTERS[slot], value)
        elif slot == "fields" and value:
            value = {_short(FIELDS, k): v for k, v in dict(value).items()}
        elif slot in ("content_hash", "reference") and value:
            value = id_bytes(value)
        elif slot == "content" and value is not None:
            value = bytes(value)
        if value or slot in ("type_class", "type_sub", "created_at", "reference"):  # empty slots are left out
            out[key] = value
    return out


def encode_claim(node: dict[str, Any], edges: list[dict[str, Any]]) -> bytes:
    """The record of a claim: its node with its references in their order."""
    return cbor.encode(record(node | {"edges": [record(e, EDGE) for e in edges]}, NODE))


def _row(record: dict[int, Any], keys: dict[str, int]) -> dict[str, Any]:
    if not isinstance(record, dict) or set(record) - set(keys.values()):
        raise ValueError("not a claim's record")
    out = {slot: record.get(key) for slot, key in keys.items()}
    for slot in _LETTERS:
        out[slot] = None if out[slot] is None else _long(_WORDS[slot], out[slot])
    out["type"] = f"{out['type_class']}/{out['type_sub']}"
    out["encoding"] = None if out["encoding_class"] is None else f"{out.pop('encoding_class')}/{out.pop('encoding_sub')}"
    out["fields"] = {_long(_WORDS["field"], k): v for k, v in (out["fields"] or {}).items()}
    out["content_hash"] = None if out["content_hash"] is None else _id_text(out["content_hash"])
    return out


def decode_claim(data: bytes, addressed: bool = True) -> tuple[dict[str, Any], list[dict[str, Any]]]:
    """The node and the references of a record; a ValueError for anything else. addressed: references with their own ids."""
    node = _row(cbor.decode(data), NODE)
    edges = []
    for ord_, raw in enumerate(node.pop("edges") or []):
        edge = _row(raw, EDGE)
        edges.append(edge | {"ord": ord_, "dst": _id_text(edge.pop("reference")), "edge_id": ids.address(cbor.encode(raw)) if addressed else None, "relation_direction": edge["relation_direction"] or 0})
    return node | {"height": node["height"] or 0}, edges


def encoded(rows: DataFrame, claim: str = "claim", edges: str = "edges") -> DataFrame:
    """rows with `encoded`: the record of a struct column with the node and an array of structs with its references, whose fields are entries. In Arrow batches."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = lambda e: e | {"fields": {f["key"]: f["value"] for f in e["fields"] or []}}
            pairs = zip(batch.column(batch.schema.get_field_index(claim)).to_pylist(), batch.column(batch.schema.get_field_index(edges)).to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([encode_claim(n, [plain(x) for x in e or []]) for n, e in pairs], pa.binary())], names=[*batch.schema.names, "encoded"])

    return rows.mapInArrow(add, StructType([*rows.schema.fields, StructField("encoded", BinaryType())]))


#: The tables' slots that a record has.
SLOTS = "type string, type_class string, type_sub string, encoding string, content binary, content_hash string, content_size long, fields map<string,string>"
NODE_SLOTS, EDGE_SLOTS = f"id string, {SLOTS}, created_at string, height long, dated string", f"src string, {SLOTS}, ord int, dst string, edge_id string, relation_direction int"


def _tables(records: DataFrame, schema: str, rows_of) -> DataFrame:
    target = to_arrow_schema(records.sparkSession.createDataFrame([], schema).schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for raw in batch.column(0).to_pylist() for r in rows_of(ids.address(raw), *decode_claim(raw))]
            columns = [pa.array([list(r[f.name].items()) if f.name == "fields" else r[f.name] for r in rows], f.type) for f in target]
            yield pa.RecordBatch.from_arrays(columns, schema=target)

    return records.mapInArrow(read, schema)


def nodes_of(records: DataFrame) -> DataFrame:
    """The nodes of claims' records (one binary column); a claim's id is its record's address."""
    return _tables(records, NODE_SLOTS, lambda id_, node, edges: [{"id": id_} | node])


def edges_of(records: DataFrame) -> DataFrame:
    """The references of claims' records (one binary column)."""
    return _tables(records, EDGE_SLOTS, lambda id_, node, edges: [{"src": id_} | e for e in edges])


#: A claim with one of its references.
CITATION = "id string, type string, height long, created_at string, dst string, reference_type string, relation_direction int"


def citations_of(records: DataFrame) -> DataFrame:
    """(name, and CITATION): the claims of records (name, encoded) with their references, a row for each reference; what joins nodes_of() and edges_of(), read once and within the record's row."""
    slots = [c.split()[0] for c in CITATION.split(", ")]
    target = to_arrow_schema(records.sparkSession.createDataFrame([], f"name string, {CITATION}").schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list[Any]] = {f.name: [] for f in target}
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                node, edges = decode_claim(raw, addressed=False)
                own = {"id": ids.address(raw), "type": node["type"], "height": node["height"], "created_at": node["created_at"]}
                for e in edges:
                    for slot, value in (own | {"dst": e["dst"], "reference_type": e["type"], "relation_direction": e["relation_direction"]}).items():
                        out[slot].append(value)
                    out["name"].append(name)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    return records.select("name", "encoded").mapInArrow(read, f"name string, {CITATION}").select("name", *slots)


def contribution(records: list[bytes]) -> tuple[dict[str, list[str]], list[Any]]:
    """The declarations and the payload of a stream's records: declarations stand first, both required ones among them; repeats of one narrow it."""
    declared: dict[str, list[str]] = {}
    payload = []
    for raw in records:
        record = cbor.decode(raw)
        if not isinstance(record, list) or len(record) < 2 or not isinstance(record[0], int):
            raise errors.MalformedRecord("a record is a list that begins with its kind")
        kind, *rest = record
        if kind in DECLARATIONS:
            if payload:
                raise errors.MalformedRecord("a declaration after the payload")
            name = DECLARATIONS[kind]
            declared[name] = narrowed(name, declared[name], rest[0]) if name in declared else list(rest[0])
        elif kind in (CLAIM, CONTENT):
            if not {"branches", "referencable"} <= declared.keys():
                raise errors.MalformedRecord("the payload comes before its declarations")
            payload.append((kind, _id_text(rest[0]), bytes(rest[1]), rest[2] if kind == CLAIM else None))
        else:
            raise errors.MalformedRecord(f"kind {kind}")
    return declared, payload


def narrowed(name: str, a: list[str], b: list[str]) -> list[str]:
    """What two declarations both permit, in the order of the first. Scopes contain one another: $universe the archive, and that every branch."""
    if name == "referencable":
        for wide in ("$universe", "$archive"):
            if wide in a:
                return list(b)
            if wide in b:
                return list(a)
    return list(dict.fromkeys(x for x in a if x in b))


def narrow(a: dict[str, list[str]], b: dict[str, list[str]]) -> dict[str, list[str]]:
    """The declarations that two streams both permit."""
    return {name: narrowed(name, a.get(name, []), b.get(name, [])) for name in DECLARATIONS.values()}
