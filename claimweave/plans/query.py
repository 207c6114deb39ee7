"""The declarative query, its validation, and its JSON form."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field
from typing import Any

from claimweave import errors
from claimweave.functions import edtf
from claimweave.model import TIME_FIELDS

UNIVERSE, ARCHIVE = "$universe", "$archive"
PROVENANCE, USES, CONNECTIONS = "provenance", "uses", "connections"
OPERATORS = ("eq", "ne", "lt", "le", "gt", "ge", "in", "glob")
CANONICAL_TIME = re.compile(r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T([01]\d|2[0-3]):[0-5]\d:[0-5]\d\.\d{9}Z", re.A)
IDENTIFIER = re.compile(r"b[a-z2-7]{20,}")

# The words that each axis admits; the empty word is its default.
ENUMS = {
    "dir": ("", PROVENANCE, USES, CONNECTIONS),
    "output.shape": ("", "single", "path"),
    "output.detail": ("", "id", "claims", "envelope"),
    "output.form": ("", "original", "materialized"),
    "output.encoding": ("", "native", "json", "cbor"),
    "output.content.overflow": ("", "cutoff", "omit"),
    "order.compare": ("", "lexical", "numeric", "temporal"),
    "order.dir": ("", "asc", "desc"),
    "execution.report": ("", "error", "warn", "info", "debug", "trace"),
}


@dataclass(frozen=True)
class Step:
    """One leg of a path. max 0 is unbounded; min 0 admits where the leg starts."""

    edges: tuple[str, ...] = ()
    dir: str = ""
    min: int | None = None
    max: int = 0
    nodes: tuple[str, ...] = ()

    @property
    def least(self) -> int:
        return 1 if self.min is None else self.min


@dataclass(frozen=True)
class Test:
    op: str
    value: Any


@dataclass(frozen=True)
class Where:
    """Exactly one form: all of, any of, not, or a test of a field."""

    all: tuple[Where, ...] = ()
    any: tuple[Where, ...] = ()
    no: Where | None = None
    field: str = ""
    test: Test | None = None


def leaf(name: str, op: str, value: Any) -> Where:
    return Where(field=name, test=Test(op, value))


@dataclass(frozen=True)
class Content:
    """How many bytes of content a claim carries; max 0: all."""

    max: int = 0
    overflow: str = ""


@dataclass(frozen=True)
class Output:
    shape: str = ""
    detail: str = ""
    form: str = ""
    content: Content | None = None
    encoding: str = ""


@dataclass(frozen=True)
class Key:
    field: str
    compare: str = ""
    dir: str = ""


@dataclass(frozen=True)
class Query:
    branch: str
    head: str | None = None
    claim: str | None = None
    path: tuple[Step, ...] = ()
    where: Where | None = None
    output: Output = field(default_factory=Output)
    order: tuple[Key, ...] = ()
    results: int = 0
    seconds: float = 0.0
    layer: str | None = None
    report: str = ""


def _one_of(axis: str, value: str) -> None:
    if value not in ENUMS[axis]:
        raise errors.Enum(f"{axis}={value!r}")


def _check_where(w: Where) -> None:
    forms = [bool(w.all), bool(w.any), w.no is not None, bool(w.field) or w.test is not None]
    if sum(forms) != 1 or (forms[3] and not (w.field and w.test)):
        raise errors.WhereForm(repr(w))
    for inner in (*w.all, *w.any, *([w.no] if w.no else [])):
        _check_where(inner)
    if w.test:
        _check_test(w.field, w.test)


def _check_test(name: str, test: Test) -> None:
    if test.op not in OPERATORS or (test.value is None) or (test.op == "in" and not isinstance(test.value, (list, tuple))):
        raise errors.ComparisonForm(f"{name}: {test!r}")
    if name != "dated" and name != "created_at" and name not in TIME_FIELDS:
        return
    accepted = (lambda s: edtf.span(s) is not None) if name == "dated" else CANONICAL_TIME.fullmatch
    for value in test.value if test.op == "in" else [test.value]:
        if test.op == "glob" or not isinstance(value, str) or not accepted(value):
            raise errors.TimeOperand(f"{name}: {test!r}")


def validate(q: Query) -> Query:
    """q itself, if it keeps every rule."""
    if not q.branch:
        raise errors.NoScope("select.branch")
    if q.branch == UNIVERSE and q.head is None:
        raise errors.NoHead("select.head")
    for i, step in enumerate(q.path):
        _one_of("dir", step.dir)
        if step.least < 0 or step.max < 0:
            raise errors.HopBounds(f"select.path[{i}]")
        if 0 < step.max < step.least:
            raise errors.Hops(f"select.path[{i}]: {step.least} > {step.max}")
    if q.where is not None:
        _check_where(q.where)
    out = q.output
    for axis in ("shape", "detail", "form", "encoding"):
        _one_of(f"output.{axis}", getattr(out, axis))
    if out.detail == "envelope" and (out.form == "materialized" or out.encoding == "json"):
        raise errors.EnvelopeAxis("an envelope is as it was stored")
    if out.content is not None:
        if out.content.max < 0:
            raise errors.Bounds("output.content.max")
        _one_of("output.content.overflow", out.content.overflow)
    if q.results < 0 or q.seconds < 0:
        raise errors.Bounds("limit")
    for i, key in enumerate(q.order):
        if not key.field:
            raise errors.OrderField(f"order[{i}]")
        _one_of("order.compare", key.compare)
        _one_of("order.dir", key.dir)
    if q.layer is not None and not q.layer.strip():
        raise errors.LayerName("execution.layer")
    _one_of("execution.report", q.report)
    if out.shape == "path" and not q.path:
        raise errors.ScanShape("output.shape path needs a path")
    return q


# JSON: every object's keys, so that unknown ones are refused.
KEYS = {
    "query": ("select", "where", "output", "order", "limit", "execution"),
    "select": ("branch", "head", "claim", "path"),
    "step": ("edges", "dir", "min", "max", "nodes"),
    "where": ("and", "or", "not", "field", "test"),
    "output": ("shape", "detail", "form", "content", "encoding"),
    "content": ("max", "overflow"),
    "key": ("field", "compare", "dir"),
    "limit": ("results", "time"),
    "execution": ("layer", "report"),
}
UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def seconds_of(text: str) -> float:
    """A duration such as 1h30m or 250ms."""
    parts = re.findall(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|ms|s|m|h)", text)
    if text == "0":
        return 0.0
    if not parts or "".join(a + b for a, b in parts) != text.lstrip("+-"):
        raise errors.MalformedQuery(f"duration {text!r}")
    return sum(float(a) * UNITS[b] for a, b in parts) * (-1 if text.startswith("-") else 1)


def _object(kind: str, value: Any) -> dict:
    if not isinstance(value, dict) or set(value) - set(KEYS[kind]):
        raise errors.MalformedQuery(f"{kind}: {value!r}")
    return value


def _typed(value: Any, kind: type, name: str) -> Any:
    if not isinstance(value, kind) or (kind is int and isinstance(value, bool)):
        raise errors.MalformedQuery(f"{name}: {value!r}")
    return value


def _identifier(value: Any, name: str) -> str | None:
    if value is None:
        return None
    if not IDENTIFIER.fullmatch(_typed(value, str, name)):
        raise errors.MalformedQuery(f"{name}: {value!r}")
    return value


def _where(value: Any) -> Where:
    w = _object("where", value)
    test = None
    if w.get("test") is not None:
        given = [(k, v) for k, v in _typed(w["test"], dict, "test").items() if v is not None]
        if len(given) != 1 or given[0][0] not in OPERATORS:
            raise errors.ComparisonForm(f"{w.get('field')}: {w['test']!r}")
        test = Test(*given[0])
    return Where(tuple(map(_where, w.get("and") or ())), tuple(map(_where, w.get("or") or ())), _where(w["not"]) if w.get("not") is not None else None, _typed(w.get("field", ""), str, "field"), test)


def decode(document: str | bytes, any_identifier: bool = False) -> Query:
    """A validated query from JSON. any_identifier admits ids that are not content addresses."""
    try:
        top = _object("query", json.loads(document))
    except json.JSONDecodeError as e:
        raise errors.MalformedQuery(str(e)) from None
    select, output = _object("select", top.get("select") or {}), _object("output", top.get("output") or {})
    limit, execution = _object("limit", top.get("limit") or {}), _object("execution", top.get("execution") or {})
    name = (lambda v, n: v) if any_identifier else _identifier
    steps = [_object("step", s) for s in select.get("path") or ()]
    content = output.get("content")
    if output.get("encoding") == "native" or execution.get("report") in ("error", "warn"):
        raise errors.Enum("a value that JSON does not admit")
    if execution.get("layer") is not None and not execution["layer"].strip():
        raise errors.LayerName("execution.layer")
    return validate(Query(
        branch=_typed(select.get("branch", ""), str, "branch"), head=name(select.get("head"), "head"), claim=name(select.get("claim"), "claim"),
        path=tuple(Step(tuple(s.get("edges") or ()), s.get("dir", ""), None if s.get("min") is None else _typed(s["min"], int, "min"), _typed(s.get("max") or 0, int, "max"), tuple(s.get("nodes") or ())) for s in steps),
        where=None if top.get("where") is None else _where(top["where"]),
        output=Output(output.get("shape", ""), output.get("detail", ""), output.get("form", ""), None if content is None else Content(_typed(_object("content", content).get("max", 0), int, "max"), content.get("overflow", "")), output.get("encoding", "")),
        order=tuple(Key(_object("key", k).get("field", ""), k.get("compare", ""), k.get("dir", "")) for k in top.get("order") or ()),
        results=_typed(limit.get("results") or 0, int, "results"), seconds=seconds_of(limit["time"]) if limit.get("time") else 0.0,
        layer=execution.get("layer"), report=execution.get("report", ""),
    ))


def _bare(mapping: dict) -> dict:
    return {k: v for k, v in mapping.items() if v not in (None, "", (), [], {})}


def encode(q: Query) -> str:
    """The JSON form of a query; decode() gives the query back."""

    def where(w: Where) -> dict:
        if w.test:
            return {"field": w.field, "test": {w.test.op: w.test.value}}
        return _bare({"and": [where(x) for x in w.all], "or": [where(x) for x in w.any], "not": where(w.no) if w.no else None})

    def duration(s: float) -> str:
        return f"{int(s)}s" if math.floor(s) == s else f"{s * 1e3:g}ms"

    steps = [_bare({"edges": list(s.edges), "dir": s.dir, "nodes": list(s.nodes)}) | ({} if s.min is None else {"min": s.min}) | ({"max": s.max} if s.max else {}) for s in q.path]
    content = q.output.content
    output = _bare({"shape": q.output.shape, "detail": q.output.detail, "form": q.output.form, "encoding": q.output.encoding}) | ({} if content is None else {"content": {"max": content.max, "overflow": content.overflow or "omit"}})
    return json.dumps(_bare({
        "select": _bare({"branch": q.branch, "head": q.head, "claim": q.claim, "path": steps}), "where": where(q.where) if q.where else None, "output": output,
        "order": [_bare({"field": k.field, "compare": k.compare, "dir": k.dir}) for k in q.order],
        "limit": _bare({"results": q.results or None, "time": duration(q.seconds) if q.seconds else None}), "execution": _bare({"layer": q.layer, "report": q.report}),
    }))
