"""The queries of the driver's contract over the star schema's claims, each with SQL that computes the same rows from the tables.

The SQL states the semantics on its own: closures as recursive unions, hop ranges by a claim's least depth plus one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.functions import edtf
from claimweave.model import Universe
from claimweave import errors
from claimweave.functions import ids, media, signatures, wire
from claimweave.functions.ids import address_column, addressed
from claimweave.operators import bookmarks, chunks, construct, lookup, membership, merge, overlay, sync, tags, verification, verify
from claimweave.operators.closure import closure
from claimweave.plans.engine import Archive, records, records_of
from claimweave.plans.query import Content, Key, Output, Query, Step, Where, leaf
from claimweave.sources import blobstores, contributions, snapshots
from claimweave.sources.starschema import ingested, universe
from claimweave.storage import scratch, stored

BASE_TEXT = "1990-01-01T00:00:00.000000000Z"
LINE = "'lineitem:' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d')"
BUCKET = "CASE WHEN year(o_orderdate) <= 1996 THEN 1 WHEN year(o_orderdate) <= 1998 THEN 2 ELSE 3 END"
_F = ("name", "mktsegment", "brand", "status", "priority", "returnflag", "event_type", "lang", "quality", "role", "size")


def _node(table: str, type_: str, id_: str, height: str, when: str | None = None, encoding: str = "NULL", size: str = "NULL", **fields: str) -> str:
    at = f"strftime({when}, '%Y-%m-%dT%H:%M:%S.%f') || '000Z'" if when else f"'{BASE_TEXT}'"
    own = ", ".join(f"CAST({fields.get(f, 'NULL')} AS VARCHAR) AS f_{f}" for f in _F)
    return f"SELECT {id_} AS id, '{type_}' AS type, CAST({encoding} AS VARCHAR) AS encoding, CAST({size} AS BIGINT) AS content_size, {at} AS created_at, CAST({height} AS BIGINT) AS height, {own} FROM {table}"


NODES = " UNION ALL ".join([
    _node("region", "entity/region", "'region:' || r_regionkey", "0", name="r_name"),
    _node("nation", "entity/nation", "'nation:' || n_nationkey", "1", name="n_name"),
    _node("customer", "entity/customer", "'customer:' || c_custkey", "2", mktsegment="c_mktsegment"),
    _node("supplier", "entity/supplier", "'supplier:' || s_suppkey", "2"),
    _node("part", "entity/part", "'part:' || p_partkey", "0", brand="p_brand"),
    _node("orders", "source/order", "'order:' || o_orderkey", "3", "o_orderdate", status="o_orderstatus", priority="o_orderpriority"),
    _node("lineitem", "relation/lineitem", LINE, "4", "l_shipdate", returnflag="l_returnflag"),
    _node("events", "source/event", "'event:' || event_id", "3", "ts", event_type="event_type"),
    _node("(SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)", "contribution/contributor", "'contributor:' || source", "0"),
    _node("documents", "source/document", "'doc:' || doc_id", "1", None, "'text/plain'", "n_chars", lang="lang"),
    _node("labels", "derivation/label", "'label:' || doc_id", "2", quality="quality"),
    _node("conversations", "source/turn", "'conv:' || conv_id || '-' || turn", "turn", role="role"),
    _node(f"(SELECT DISTINCT r, p FROM (SELECT DISTINCT o_orderpriority AS p FROM orders), (VALUES (1), (2), (3)) v(r))", "contribution/head", "'head:' || r || '-' || p", "r + 3"),
    _node("(VALUES (1), (2), (3)) v(r)", "contribution/branches", "'table:' || r", "r + 4"),
])


def _edge(table: str, src: str, type_: str, dst: str, direction: int = 0, where: str = "") -> str:
    return f"SELECT {src} AS src, {dst} AS dst, '{type_}' AS type, {direction} AS dir FROM {table} {where}"


HEADS = "(SELECT DISTINCT r, p FROM (SELECT DISTINCT o_orderpriority AS p FROM orders), (VALUES (1), (2), (3)) v(r))"
EDGES = " UNION ALL ".join([
    _edge("nation", "'nation:' || n_nationkey", "derivation/region", "'region:' || n_regionkey"),
    _edge("customer", "'customer:' || c_custkey", "derivation/nation", "'nation:' || c_nationkey"),
    _edge("supplier", "'supplier:' || s_suppkey", "derivation/nation", "'nation:' || s_nationkey"),
    _edge("orders", "'order:' || o_orderkey", "derivation/customer", "'customer:' || o_custkey"),
    _edge("lineitem", LINE, "derivation/order", "'order:' || l_orderkey"),
    _edge("lineitem", LINE, "relation/part", "'part:' || l_partkey", 1),
    _edge("lineitem", LINE, "relation/supplier", "'supplier:' || l_suppkey", -1),
    _edge("events", "'event:' || event_id", "derivation/customer", "'customer:' || user_id"),
    _edge("documents", "'doc:' || doc_id", "contribution/contributor", "'contributor:' || source", 0, "WHERE source IS NOT NULL"),
    _edge("labels", "'label:' || doc_id", "derivation/source", "'doc:' || doc_id"),
    _edge("conversations", "'conv:' || conv_id || '-' || turn", "derivation/previous", "'conv:' || conv_id || '-' || (turn - 1)", 0, "WHERE turn > 0"),
    _edge("orders", f"'head:' || ({BUCKET}) || '-' || o_orderpriority", "contribution/head", "'order:' || o_orderkey"),
    _edge(HEADS, "'head:' || r || '-' || p", "contribution/head", "'head:' || (r - 1) || '-' || p", 0, "WHERE r > 1"),
    _edge(HEADS, "'table:' || r", "contribution/branch", "'head:' || r || '-' || p"),
    _edge("(VALUES (2), (3)) v(r)", "'table:' || r", "contribution/diff", "'table:' || (r - 1)"),
])


def sql(body: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ", ".join([f"nodes AS ({NODES})", f"edges AS ({EDGES})", *ctes]) + f" {body}"


def reach(name: str, start: str) -> str:
    """A CTE: the closure of the ids that start selects."""
    return f"{name}(id) AS ({start} UNION SELECT e.dst FROM {name} c JOIN edges e ON e.src = c.id)"


def _matches(column: str, pattern: str) -> str:
    """A pattern of this module: a type, or a class with any subtype."""
    return f"{column} LIKE '{pattern[:-1]}%'" if pattern.endswith("/*") else f"{column} = '{pattern}'"


def _typed(column: str, patterns: tuple[str, ...]) -> str:
    yes = [_matches(column, p) for p in patterns if p[0] != "-"]
    no = [f"NOT {_matches(column, p[1:])}" for p in patterns if p[0] == "-"]
    return " AND ".join([f"({' OR '.join(yes)})"] * bool(yes) + no) or "TRUE"


def stepped(name: str, start: str, step: Step, scope: str | None = None, reverse: str | None = None) -> list[str]:
    """CTEs of one step; `name` holds what it collects. start, scope and reverse name tables of ids."""
    forward = f"SELECT src AS a, dst AS b FROM edges WHERE {_typed('type', step.edges)}"
    inside = f" AND src IN (SELECT id FROM {reverse})" if reverse else ""
    backward = f"SELECT dst AS a, src AS b FROM edges WHERE {_typed('type', step.edges)}{inside}"
    hops = {"uses": backward, "connections": f"{forward} UNION ALL {backward}"}.get(step.dir, forward)
    most = step.max or 64  # more than the highest claim
    got = f"SELECT h.b AS id FROM {name}_d d JOIN {name}_h h ON h.a = d.id WHERE d.d + 1 BETWEEN {step.least} AND {most}"
    if step.least == 0:
        got += f" UNION ALL SELECT id FROM {start}"
    limits = ([f"id IN (SELECT id FROM nodes WHERE {_typed('type', step.nodes)})"] if step.nodes else []) + ([f"id IN (SELECT id FROM {scope})"] if scope else [])
    return [
        f"{name}_h AS (SELECT DISTINCT a, b FROM ({hops}))",
        f"{name}_w(id, d) AS (SELECT id, 0 FROM {start} UNION SELECT h.b, w.d + 1 FROM {name}_w w JOIN {name}_h h ON h.a = w.id WHERE w.d < {most})",
        f"{name}_d AS (SELECT id, min(d) AS d FROM {name}_w GROUP BY id)",
        f"{name} AS (SELECT DISTINCT id FROM ({got}) x {'WHERE ' + ' AND '.join(limits) if limits else ''})",
    ]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
HEAD = "table:3"


_ARCHIVES: dict[tuple[str, str], Archive] = {}


def archive(spark: SparkSession, sf_dir: str) -> Archive:
    """The snapshot at HEAD: one for each application and directory, so that its closures are walked once."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _ARCHIVES:
        _ARCHIVES[key] = Archive(ingested(spark, sf_dir), HEAD)
    return _ARCHIVES[key]


def _add(name: str, query: Query, oracle: str | None, *columns: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return archive(spark, sf_dir).query(query).rows.select(*(columns or ("id",)))

    QUERIES[name] = run
    if oracle is not None:
        SQL[name] = oracle


def _ids(*values: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{v}')" for v in values) + ") v(id)"


def _path(name: str, branch: str, claim: str | None, *steps: Step, head: str | None = None, ids_only: bool = True) -> None:
    """A path query and its SQL: scope, start, and the steps one after the other."""
    ctes, scope, root = [], None, head
    if branch != "$universe":
        root = HEAD if branch == "$archive" else f"head:3-{branch}"
        ctes.append(reach("scope", _ids(root)))
        scope = "scope"
    ctes.append(reach("origin", _ids(head or root)))
    ctes.append(f"start AS ({_ids(claim)})" if claim else f"start AS (SELECT id FROM origin {'WHERE id IN (SELECT id FROM scope)' if scope else ''})")
    ctes.append(reach("inside", _ids(root)))
    if head and scope:
        ctes.append("both AS (SELECT id FROM scope INTERSECT SELECT id FROM origin)")
        scope = "both"
    at = "start"
    for i, s in enumerate(steps):
        ctes += stepped(f"s{i}", at, s, scope, "inside")
        at = f"s{i}"
    _add(name, Query(branch, head=head, claim=claim, path=steps, output=Output(detail="id")), sql(f"SELECT id FROM {at}", *ctes))


def _scan(name: str, where: Where | None, condition: str, branch: str = "$archive", order: tuple[Key, ...] = (), keys: str = "", results: int = 0) -> None:
    """A filter over a branch's closure; with results, the positions of the first ones."""
    root = HEAD if branch == "$archive" else f"head:3-{branch}"
    ctes = [reach("scope", _ids(root))]
    body = f"SELECT n.* FROM nodes n JOIN scope USING (id) WHERE {condition}"
    if not results:
        _add(name, Query(branch, where=where, order=order), sql(f"SELECT id, type, height FROM ({body})", *ctes), "id", "type", "height")
        return

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = archive(spark, sf_dir).query(Query(branch, where=where, order=order, results=results)).rows
        from claimweave.plans.predicate import sort_columns

        return found.select("id", "type", F.row_number().over(Window.orderBy(*sort_columns(order))).cast("long").alias("position"))

    QUERIES[name] = run
    SQL[name] = sql(f"SELECT id, type, CAST(row_number() OVER (ORDER BY {keys + ', ' if keys else ''}created_at, id) AS BIGINT) AS position FROM ({body}) QUALIFY position <= {results}", *ctes)


SCOPE = "1-URGENT"
NONE = leaf("nothing", "eq", "x")

# Scopes and closures
_add("closure_branch", Query(SCOPE, output=Output(detail="id")), sql("SELECT id FROM c", reach("c", _ids(f"head:3-{SCOPE}"))))
_add("closure_universe", Query("$universe", head=HEAD, output=Output(detail="id")), sql("SELECT id FROM c", reach("c", _ids(HEAD))))
_add("closure_archive", Query("$archive", output=Output(detail="id")), sql("SELECT id FROM c", reach("c", _ids(HEAD))))
_add("closure_from_order", Query("$universe", head="order:7", output=Output(detail="id")), sql("SELECT id FROM c", reach("c", _ids("order:7"))))
_add("head_intersect_scope", Query(SCOPE, head="head:1-" + SCOPE, output=Output(detail="id")), sql("SELECT id FROM a INTERSECT SELECT id FROM c", reach("a", _ids(f"head:3-{SCOPE}")), reach("c", _ids(f"head:1-{SCOPE}"))))
_add("archive_branch_tables", Query("$archive", where=leaf("type", "glob", "contribution/branches")), sql("SELECT id FROM c WHERE id LIKE 'table:%'", reach("c", _ids(HEAD))))
_path("anchored_scan", SCOPE, f"head:2-{SCOPE}", Step(min=0))

# Paths
_path("path_derivation_d1", "$universe", "order:1", Step(("derivation/*",), max=1), head="order:1")
_path("path_derivation_d3", "$universe", None, Step(("derivation/*",), max=3), head=f"head:1-{SCOPE}")
_path("path_derivation_unbounded", "$archive", f"head:2-{SCOPE}", Step(("contribution/head",), max=1), Step(("derivation/*",)))
_path("path_contribution_d2", "$archive", HEAD, Step(("contribution/*",), max=2))
_path("path_min0", "$archive", "order:1", Step(("derivation/*",), min=0, max=2))
_path("path_min2_max3", "$archive", f"head:3-{SCOPE}", Step(min=2, max=3))
_path("path_edges_exclude", "$universe", "doc:3", Step(("-contribution/*",), min=0, max=3), head="doc:3")
_path("path_edges_multi", "$archive", "table:2", Step(("contribution/branch", "contribution/head"), max=2))
_path("path_nodes_multi_exclude", "$archive", None, Step(nodes=("source/*", "entity/*", "-entity/region")))
_path("path_nodes_exclude", "$archive", f"head:1-{SCOPE}", Step(nodes=("-contribution/*",), max=2))
_path("path_two_step", "$archive", None, Step(nodes=("source/order",)), Step(("derivation/*",), nodes=("entity/customer",), max=1))
_path("path_uses", "$archive", "customer:4", Step(dir="uses", edges=("derivation/*",), max=1))
_path("path_uses_two_levels", "$archive", "nation:3", Step(dir="uses", edges=("derivation/*",), nodes=("source/*",), max=2))
_path("path_uses_of_customers_branch", SCOPE, None, Step(min=0, nodes=("entity/customer",)), Step(dir="uses", edges=("derivation/*",), nodes=("source/*",), max=1))
_path("path_connections_2", "$archive", "customer:4", Step(dir="connections", edges=("derivation/*",), max=2))
_path("path_connections_return", "$archive", "customer:4", Step(dir="connections", min=2, max=2))
_path("unanchored_step", SCOPE, None, Step(("derivation/customer",), nodes=("entity/*",), max=1))
_path("unanchored_min1_max2", SCOPE, None, Step(("derivation/*",), min=1, max=2))
_path("path_chain_of_turns", "$universe", "conv:5-2", Step(("derivation/previous",)), head="conv:5-2")

# Filters
_scan("where_type_glob", leaf("type", "glob", "source/*"), "type LIKE 'source/%'")
_scan("where_glob_star_stays_in_segment", Where(any=(leaf("type", "glob", "*"), leaf("type", "glob", "*/re*"))), "type = 'entity/region'")
_scan("where_glob_class", leaf("type", "glob", "entity/[c-r]*"), "type IN ('entity/customer', 'entity/nation', 'entity/part', 'entity/region')")
_scan("where_type_eq", leaf("type", "eq", "entity/customer"), "type = 'entity/customer'")
_scan("where_type_ne", leaf("type", "ne", "source/order"), "type <> 'source/order'")
_scan("where_type_in", leaf("type", "in", ["entity/nation", "entity/region", "source/none"]), "type IN ('entity/nation', 'entity/region')")
_scan("where_in_empty", Where(any=(leaf("type", "in", []), leaf("height", "eq", 1))), "height = 1")
_scan("where_height_ge", leaf("height", "ge", 3), "height >= 3", SCOPE)
_scan("where_height_lt", leaf("height", "lt", 3), "height < 3", SCOPE)
_scan("where_height_le", leaf("height", "le", 2), "height <= 2", SCOPE)
_scan("where_height_gt", leaf("height", "gt", 3), "height > 3", SCOPE)
_scan("where_height_eq_text", leaf("height", "eq", "2"), "height = 2", SCOPE)
_scan("where_height_ge_text_never", Where(any=(leaf("height", "ge", "2"), leaf("height", "eq", "1"))), "height = 1", SCOPE)
_scan("where_field_eq", leaf("status", "eq", "F"), "f_status = 'F'", SCOPE)
_scan("where_field_ne_absent_is_false", leaf("status", "ne", "F"), "f_status <> 'F'", SCOPE)
_scan("where_field_order_by_bytes", leaf("mktsegment", "lt", "C"), "f_mktsegment < 'C'", SCOPE)
_scan("where_field_number_never_orders", Where(any=(leaf("mktsegment", "ge", 5), leaf("mktsegment", "ge", "M"))), "f_mktsegment >= 'M'", SCOPE)
_scan("where_missing_field", Where(any=(NONE, leaf("nothing", "ne", "x"), leaf("height", "eq", 0))), "height = 0", SCOPE)
_scan("where_not_missing_field", Where(no=NONE), "TRUE", SCOPE)
_scan("where_time_ge", leaf("created_at", "ge", "1997-01-01T00:00:00.000000000Z"), "created_at >= '1997-01-01T00:00:00.000000000Z'", SCOPE)
_scan("where_and", Where(all=(leaf("type", "glob", "source/*"), leaf("height", "ge", 1))), "type LIKE 'source/%' AND height >= 1", SCOPE)
_scan("where_or", Where(any=(leaf("type", "eq", "entity/nation"), leaf("status", "eq", "O"))), "type = 'entity/nation' OR f_status = 'O'", SCOPE)
_scan("where_not", Where(no=leaf("type", "glob", "contribution/*")), "type NOT LIKE 'contribution/%'", SCOPE)
_scan("where_nested", Where(all=(Where(any=(leaf("type", "glob", "source/*"), leaf("type", "glob", "entity/*"))), Where(no=leaf("height", "eq", 0)))), "(type LIKE 'source/%' OR type LIKE 'entity/%') AND height <> 0", SCOPE)


def _documents(name: str, where: Where, condition: str) -> None:
    """Filters on content, over the document claims that no branch holds."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from claimweave.plans.predicate import filter_of

        return ingested(spark, sf_dir).nodes.where("type = 'source/document'").where(filter_of(where)).select("id", "content_size")

    QUERIES[name] = run
    SQL[name] = sql(f"SELECT id, content_size FROM nodes WHERE type = 'source/document' AND {condition}")


_documents("where_content_size_gt", leaf("content_size", "gt", 2000), "content_size > 2000")
_documents("where_content_size_le", leaf("content_size", "le", 500.5), "content_size <= 500.5")
_documents("where_encoding_glob", leaf("encoding", "glob", "text/*"), "encoding LIKE 'text/%'")

# Order and bounds
_scan("order_height_desc_limit", None, "TRUE", SCOPE, (Key("height", "numeric", "desc"),), "height DESC", 20)
_scan("order_height_asc_limit", None, "TRUE", SCOPE, (Key("height", "numeric", "asc"),), "height", 30)
_scan("order_height_lexical", None, "TRUE", "$archive", (Key("height", "lexical"),), "CAST(height AS VARCHAR)", 40)
_scan("order_created_desc", None, "TRUE", SCOPE, (Key("created_at", "", "desc"),), "created_at DESC", 25)
_scan("order_type_lexical", None, "TRUE", SCOPE, (Key("type", "lexical"),), "type", 40)
_scan("order_multi_key", None, "TRUE", SCOPE, (Key("type", "lexical"), Key("height", "numeric", "desc")), "type, height DESC", 40)
_scan("order_missing_last_asc", leaf("height", "le", 2), "height <= 2", SCOPE, (Key("mktsegment"),), "f_mktsegment ASC NULLS LAST", 60)
_scan("order_missing_last_desc", leaf("height", "le", 2), "height <= 2", SCOPE, (Key("mktsegment", "", "desc"),), "f_mktsegment DESC NULLS LAST", 60)
_scan("order_temporal", None, "TRUE", SCOPE, (Key("created_at", "temporal", "desc"),), "created_at DESC", 15)
_scan("limit_results", None, "TRUE", SCOPE, (), "", 5)


def registered(oracle: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            SQL[f.__name__] = oracle
        return f

    return put


@registered(sql(f"SELECT count(*) > 7 AS truncated FROM c", reach("c", _ids(f"head:3-{SCOPE}"))))
def topk_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a bound of seven left something out."""
    got = archive(spark, sf_dir).query(Query(SCOPE, results=7))
    return spark.createDataFrame([(got.truncated(),)], "truncated boolean")


@registered(sql("SELECT o.dst AS id, 'order:1>' || o.dst AS route FROM edges o WHERE o.src = 'order:1' UNION ALL SELECT c.dst, 'order:1>' || o.dst || '>' || c.dst FROM edges o JOIN edges c ON c.src = o.dst WHERE o.src = 'order:1' UNION ALL SELECT n.dst, 'order:1>' || o.dst || '>' || c.dst || '>' || n.dst FROM edges o JOIN edges c ON c.src = o.dst JOIN edges n ON n.src = c.dst WHERE o.src = 'order:1'"))
def shape_path_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical routes from an order to what it derives from."""
    q = Query("$universe", head="order:1", claim="order:1", path=(Step(("derivation/*",), max=3),), output=Output(shape="path", detail="id"))
    return archive(spark, sf_dir).query(q).rows.select("id", F.array_join("route", ">").alias("route"))


@registered(sql("""SELECT id, min(route) AS route FROM (
    SELECT c.src AS id, 'nation:3>' || c.src AS route, 1 AS hop FROM edges c WHERE c.dst = 'nation:3' AND c.src IN (SELECT id FROM inside) AND c.type LIKE 'derivation/%'
    UNION ALL SELECT o.src, 'nation:3>' || c.src || '>' || o.src, 2 FROM edges c JOIN edges o ON o.dst = c.src WHERE c.dst = 'nation:3' AND c.type LIKE 'derivation/%' AND o.type LIKE 'derivation/%' AND o.src IN (SELECT id FROM inside) AND c.src IN (SELECT id FROM inside)
) GROUP BY id""", reach("inside", _ids(HEAD))))
def shape_path_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes along references backwards."""
    q = Query("$archive", claim="nation:3", path=(Step(("derivation/*",), "uses", max=2),), output=Output(shape="path", detail="id"))
    return archive(spark, sf_dir).query(q).rows.select("id", F.array_join("route", ">").alias("route"))


@registered(sql("""SELECT n.id, '{"created_at":"' || created_at || '"' || CASE WHEN e.dst IS NULL THEN '' ELSE ',"edges":[{"reference":"' || e.dst || '","type":"' || e.type || '"}]' END || ',"fields":{"name":"' || f_name || '"},"height":' || height || ',"id":"' || n.id || '","type":"' || n.type || '"}' AS encoded
    FROM nodes n LEFT JOIN edges e ON e.src = n.id WHERE n.type IN ('entity/nation', 'entity/region') AND n.id IN (SELECT id FROM c)""", reach("c", _ids(HEAD))))
def json_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims as JSON with their references; absent values are left out."""
    q = Query("$archive", where=leaf("type", "in", ["entity/nation", "entity/region"]), output=Output(encoding="json"))
    return archive(spark, sf_dir).query(q).rows.select("id", "encoded")


@registered(sql("SELECT n.id, n.type, n.height, n.created_at, e.dst AS reference, e.type AS reference_type, e.dir AS direction FROM nodes n JOIN edges e ON e.src = n.id WHERE n.type = 'relation/lineitem' AND n.f_returnflag = 'R'"))
def cbor_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims as CBOR records, and what the records say when they are read again."""
    made = wire.encoded(records_of(ingested(spark, sf_dir), "relation/lineitem", "fields['returnflag'] = 'R'")).select(F.col("id").alias("name"), "encoded")
    # the address of the record goes along: a claim's id when it is read again has to be that
    again = wire.citations_of(addressed(made, "encoded").select(F.concat_ws("\n", "address", "name").alias("name"), "encoded"))
    again = again.where(F.substring_index("name", "\n", 1) == F.col("id"))
    return again.select(F.expr("substring(name, length(id) + 2)").alias("id"), "type", "height", "created_at", F.col("dst").alias("reference"), "reference_type", F.col("relation_direction").alias("direction"))


@registered(sql("SELECT o.dst AS id, 'order:1|' || o.dst AS route FROM edges o WHERE o.src = 'order:1' UNION ALL SELECT c.dst, 'order:1|' || o.dst || '|' || c.dst FROM edges o JOIN edges c ON c.src = o.dst WHERE o.src = 'order:1'"))
def routes_of_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes with the claims along them, not their ids alone."""
    q = Query("$universe", head="order:1", claim="order:1", path=(Step(("derivation/*",), max=2),), output=Output("path"))
    return archive(spark, sf_dir).query(q).rows.select("id", F.array_join(F.transform("claims", lambda c: c.getField("id")), "|").alias("route"))


def variant(spark: SparkSession, sf_dir: str, **tables: DataFrame) -> Archive:
    """The snapshot with other columns in some tables; ids and references are the same, and so are the closures."""
    own = archive(spark, sf_dir)
    out = Archive(own.universe.with_(**({"dangling": own.universe.dangling} | tables)), HEAD)
    out._closures, out._known, out._gaps = own._closures, own._known, own._gaps
    return out


def _bodies(spark: SparkSession, sf_dir: str) -> Archive:
    """Orders with their priority as content, and references to customers with the customer's id as theirs."""
    u = ingested(spark, sf_dir)
    body = F.when(F.col("type") == "source/order", F.try_element_at("fields", F.lit("priority")).cast("binary"))
    cited = F.when(F.col("type") == "derivation/customer", F.col("dst").cast("binary"))
    sized = lambda d, c: d.withColumn("content", c).withColumn("content_size", F.length("content").cast("long")).withColumn("encoding", F.when(F.col("content").isNotNull(), "text/plain"))
    return variant(spark, sf_dir, nodes=sized(u.nodes, body), edges=sized(u.edges, cited), kinds=u.kinds)


_ORDERS = f"o AS (SELECT 'order:' || o_orderkey AS id, 'customer:' || o_custkey AS cited, o_orderpriority AS body FROM orders WHERE o_orderpriority = '{SCOPE}')"


def _content(name: str, content: Content | None, encoding: str, body: str, cited: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _bodies(spark, sf_dir).query(Query(SCOPE, where=leaf("type", "eq", "source/order"), output=Output(content=content, encoding=encoding))).rows
        if not encoding:
            return rows.select("id", F.col("content").cast("string").alias("body"), "content_size")
        of = lambda path: F.unbase64(F.get_json_object("encoded", path)).cast("string")
        return rows.select("id", of("$.content").alias("body"), of("$.edges[0].content").alias("cited"), F.get_json_object("encoded", "$.content_size").cast("long").alias("content_size"))

    QUERIES[name] = run
    SQL[name] = f"WITH {_ORDERS} SELECT id, {body} AS body, {f'{cited} AS cited, ' if encoding else ''}CAST(strlen(body) AS BIGINT) AS content_size FROM o"


_LEFT = "14 - strlen(cited)"
_content("content_whole_native", None, "", "body", "")
_content("content_cutoff_native", Content(14, "cutoff"), "", f"CASE WHEN strlen(body) <= {_LEFT} THEN body WHEN {_LEFT} > 0 THEN left(body, CAST({_LEFT} AS INTEGER)) END", "")
_content("content_none", None, "json", "NULL::VARCHAR", "NULL::VARCHAR")
_content("content_whole", Content(), "json", "body", "cited")
_content("content_cutoff", Content(14, "cutoff"), "json", f"CASE WHEN strlen(body) <= {_LEFT} THEN body WHEN {_LEFT} > 0 THEN left(body, CAST({_LEFT} AS INTEGER)) END", "CASE WHEN strlen(cited) <= 14 THEN cited ELSE left(cited, 14) END")
_content("content_omit", Content(21, "omit"), "json", "CASE WHEN strlen(cited) + strlen(body) <= 21 THEN body END", "CASE WHEN strlen(cited) <= 21 THEN cited END")


@registered("""WITH parts AS (SELECT 'doc:' || doc_id AS id, 0 AS ord, left(lang, 2) || source AS body FROM documents UNION ALL SELECT 'doc:' || doc_id, 1, left(source, 4) FROM documents UNION ALL SELECT 'doc:' || doc_id, 2147483647, CAST(n_chars AS VARCHAR) FROM documents),
    summed AS (SELECT id, ord, body, strlen(body) AS n, COALESCE(sum(strlen(body)) OVER (PARTITION BY id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM parts)
    SELECT id, CAST(ord AS INTEGER) AS ord, CASE WHEN before + n <= 10 THEN body WHEN before < 10 THEN left(body, CAST(10 - before AS INTEGER)) END AS body FROM summed""")
def content_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cap of ten bytes over references' contents in order, then the claim's own; the last one is cut."""
    from claimweave.plans.engine import budget

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bytes_ = lambda c: c.cast("binary").alias("content")
    sized = lambda df: df.withColumn("content_size", F.length("content").cast("long"))
    id_ = F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))
    claims = sized(docs.select(id_.alias("id"), bytes_(F.col("n_chars").cast("string"))))
    edges = sized(docs.select(id_.alias("src"), F.lit(0).alias("ord"), bytes_(F.concat(F.substring("lang", 1, 2), "source"))).unionByName(docs.select(id_.alias("src"), F.lit(1).alias("ord"), bytes_(F.substring("source", 1, 4)))))
    return budget(claims, edges, Content(10, "cutoff")).select("id", "ord", F.col("content").cast("string").alias("body"))


# Overlays and tags
def revisions(spark: SparkSession, sf_dir: str) -> Universe:
    """Orders of a customer as revisions of one another: each lies over the one before. Open orders state their status, urgent ones their priority and content."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = orders.withColumn("before", F.lag("o_orderkey").over(w))
    id_ = F.concat(F.lit("order:"), F.col("o_orderkey").cast("string"))
    fields = F.map_filter(F.create_map(F.lit("status"), F.when(F.col("o_orderstatus") == "O", "O"), F.lit("priority"), F.when(F.col("o_orderpriority").startswith("1"), F.col("o_orderpriority")), F.lit("fields_diff_omit"), F.when(F.col("o_orderpriority").startswith("5"), F.lit("status"))), lambda k, v: v.isNotNull())
    body = F.when(F.col("o_orderpriority").startswith("2"), F.col("o_orderkey").cast("string").cast("binary"))
    nodes = rows.select(id_.alias("id"), fields.alias("fields"), F.when(body.isNotNull(), F.lit("text/plain")).alias("encoding"), body.alias("content"), F.lit(None).cast("string").alias("content_hash"), F.length(body).cast("long").alias("content_size"))
    edges = rows.where("before is not null").select(id_.alias("src"), F.concat(F.lit("order:"), F.col("before").cast("string")).alias("dst"), F.lit("contribution/diff").alias("type"))
    return Universe(nodes, edges)


@registered("""WITH RECURSIVE r AS (SELECT 'order:' || o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, o_custkey, CASE WHEN o_orderstatus = 'O' THEN 'O' END AS own_status, CASE WHEN o_orderpriority LIKE '1%' THEN o_orderpriority END AS own_priority, o_orderpriority LIKE '5%' AS omits, CASE WHEN o_orderpriority LIKE '2%' THEN CAST(o_orderkey AS VARCHAR) END AS own_content FROM orders),
    e AS (SELECT id, k, o_custkey, own_status AS status, own_priority AS priority, own_content AS content FROM r WHERE k = 1
    UNION ALL SELECT r.id, r.k, r.o_custkey, COALESCE(r.own_status, CASE WHEN NOT r.omits THEN e.status END), COALESCE(r.own_priority, e.priority), COALESCE(r.own_content, e.content) FROM e JOIN r ON r.o_custkey = e.o_custkey AND r.k = e.k + 1)
    SELECT id, status, priority, content FROM e""")
def diff_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective fields and content along diff chains, with names omitted and restated."""
    u = revisions(spark, sf_dir)
    field = lambda name: F.try_element_at("fields", F.lit(name)).alias(name)
    return overlay.materialised(u.nodes, u.edges).select("id", field("status"), field("priority"), F.col("content").cast("string").alias("content"))


@registered("""WITH c AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN event_type END AS own, event_id % 1000 = 500 AS omits FROM events),
    g AS (SELECT event_id, own, sum(CASE WHEN own IS NOT NULL OR omits THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS part FROM c)
    SELECT 'event:' || event_id AS id, max(own) OVER (PARTITION BY part) AS kind FROM g""")
def overlay_long_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one chain, each lying over the one before: every seventh states its type, some omit what they inherit."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    id_ = lambda c: F.concat(F.lit("event:"), c.cast("string"))
    fields = F.map_filter(F.create_map(F.lit("kind"), F.when(F.col("event_id") % 7 == 0, F.col("event_type")), F.lit("fields_diff_omit"), F.when(F.col("event_id") % 1000 == 500, F.lit("kind"))), lambda k, v: v.isNotNull())
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    nodes = events.select(id_(F.col("event_id")).alias("id"), fields.alias("fields"), null("string", "encoding"), null("binary", "content"), null("string", "content_hash"), null("long", "content_size"))
    edges = events.where("event_id > 0").select(id_(F.col("event_id")).alias("src"), id_(F.col("event_id") - 1).alias("dst"), F.lit("contribution/diff").alias("type"))
    return overlay.materialised(nodes, edges).select("id", F.try_element_at("fields", F.lit("kind")).alias("kind"))


@registered("SELECT * FROM (VALUES ('archive', 'DanglingReference'), ('path', 'DanglingReference'), ('elsewhere', 'none'), ('head', 'NotFound'), ('branch', 'BranchNotFound')) v(query, refusal)")
def gap_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations are taken out of the store: reads that arrive at one are refused, others are not; neither are things that never were."""
    u = ingested(spark, sf_dir)
    torn = Archive(u.with_(nodes=u.nodes.where("type <> 'entity/nation'")), HEAD)
    asked = {"archive": Query("$archive"), "path": Query("$universe", head="customer:4", claim="customer:4", path=(Step(max=1),)), "elsewhere": Query("$universe", head="doc:3"), "head": Query("$universe", head="nothing"), "branch": Query("nowhere")}

    def refusal(query: Query) -> str:
        try:
            torn.query(query)
        except errors.ClaimError as e:
            return type(e).__name__
        return "none"

    return spark.createDataFrame([(name, refusal(query)) for name, query in asked.items()], "query string, refusal string")


def _tables(u: Universe) -> DataFrame:
    return u.branches.join(u.spine.select(F.col("id").alias("table_id"), "height"), "table_id").select("name", "head", "height")


@registered(sql("SELECT id, '_b_' || name AS key, CAST(min(height) AS VARCHAR) AS value FROM (SELECT t.name, t.height, c.id FROM tables t JOIN c ON c.head = t.head) GROUP BY id, name", f"tables AS (SELECT 'head:' || r || '-' || p AS head, p AS name, r + 4 AS height FROM {HEADS})", "c(head, id) AS (SELECT head, head FROM tables UNION SELECT c.head, e.dst FROM c JOIN edges e ON e.src = c.id)"))
def tag_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags that say since which branch table a branch holds a claim."""
    u = ingested(spark, sf_dir)
    return tags.joined_at(_tables(u), u.edges)


@registered(sql("SELECT id FROM c", reach("c", _ids(f"head:2-{SCOPE}"))))
def tags_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A branch as the second table held it, from tags alone."""
    u = ingested(spark, sf_dir)
    return tags.members(tags.joined_at(_tables(u), u.edges), SCOPE, 6)


@registered(sql("SELECT n.id, n.id IN (SELECT id FROM c) AS member FROM nodes n WHERE n.type = 'entity/customer'", reach("c", _ids(f"head:1-{SCOPE}", "head:1-5-LOW"))))
def claims_in_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer, whether one of two branches holds it."""
    u = ingested(spark, sf_dir)
    heads = spark.createDataFrame([(f"head:1-{SCOPE}",), ("head:1-5-LOW",)], "id string")
    return tags.in_branches(u.nodes.where("type = 'entity/customer'").select("id"), heads, u.edges)


@registered(f"SELECT 'head:3-' || p AS head, p AS name FROM (SELECT DISTINCT o_orderpriority AS p FROM orders)")
def branch_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(spark, sf_dir).branches()


@registered("SELECT 'nowhere' AS name")
def missing_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(spark, sf_dir).missing_branches([SCOPE, "nowhere"])


@registered("SELECT 'table:' || r AS id, CAST(r AS INTEGER) AS revision FROM (VALUES (1), (2), (3)) v(r)")
def spine_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of branch tables from the archive's head down."""
    u = ingested(spark, sf_dir)
    found = closure(spark.createDataFrame([(HEAD,)], "id string"), u.edges.where("type in ('contribution/diff', 'contribution/branches')"))
    return u.spine.join(found, "id", "left_semi").select("id", "revision")


# Single claims and branches
@registered(sql("SELECT id, type, height FROM nodes WHERE id = 'customer:4' AND id IN (SELECT id FROM c)", reach("c", _ids(HEAD))))
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One claim of the archive by its id."""
    return archive(spark, sf_dir).get("$archive", "customer:4").select("id", "type", "height")


_ASKED = ("customer:4", "order:1", "order:2", "order:3", "region:1", "part:5", "head:1-5-LOW", "nothing")


@registered(sql(f"SELECT a.id, a.id IN (SELECT id FROM c) AS member FROM ({_ids(*_ASKED)}) a", reach("c", _ids(f"head:3-{SCOPE}"))))
def membership_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a branch holds each of some claims."""
    own = archive(spark, sf_dir)
    return spark.createDataFrame([(i, own.holds(SCOPE, i)) for i in _ASKED], "id string, member boolean")


@registered(sql(f"SELECT p.name, p.name IN (SELECT o_orderpriority FROM orders) AS held, CASE WHEN p.name IN (SELECT o_orderpriority FROM orders) THEN 'head:2-' || p.name END AS previous FROM (VALUES ('{SCOPE}'), ('5-LOW'), ('nowhere')) p(name)"))
def branch_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the archive has a branch, and its head before: heads are revisions of one another here."""
    u = ingested(spark, sf_dir)
    older = (F.col("src").like("head:%")) & (F.col("dst").like("head:%"))
    own = variant(spark, sf_dir, edges=u.edges.withColumn("type", F.when(older, "contribution/diff").otherwise(F.col("type"))))
    return spark.createDataFrame([(n, own.has_branch(n), own.previous(n) if own.has_branch(n) else None) for n in (SCOPE, "5-LOW", "nowhere")], "name string, held boolean, previous string")


@registered(sql(f"SELECT src, dst, type FROM edges WHERE type IN ('contribution/branch', 'contribution/diff') AND (type = 'contribution/branch' AND dst LIKE 'head:%-{SCOPE}' OR type = 'contribution/diff')"))
def reference_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by type, and by a field's value."""
    edges = ingested(spark, sf_dir).edges
    named = lookup.references(edges, types=["contribution/branch", "contribution/head"], field=("name", SCOPE))
    return named.unionByName(lookup.references(edges, type_="contribution/diff")).select("src", "dst", "type")


@registered(sql(f"SELECT CAST(a.position AS INTEGER) AS position, a.id, n.id IS NOT NULL AS held, n.height FROM (VALUES {', '.join(f'({k}, {chr(39)}{i}{chr(39)})' for k, i in enumerate((*_ASKED, 'order:1')))}) a(position, id) LEFT JOIN nodes n USING (id)"))
def positional_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims by position: whether the store has each, and its height."""
    asked = spark.createDataFrame(list(enumerate((*_ASKED, "order:1"))), "position int, id string")
    return lookup.positioned(asked, ingested(spark, sf_dir).nodes)


# Sync, deletion and write-path sets
@registered(sql("SELECT id FROM a EXCEPT SELECT id FROM b", reach("a", _ids(f"head:2-{SCOPE}")), reach("b", _ids(f"head:1-{SCOPE}"))))
def copy_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store with the first revision lacks of the second."""
    u = ingested(spark, sf_dir)
    one = lambda x: spark.createDataFrame([(x,)], "id string")
    return sync.missing_claims(u, one(f"head:2-{SCOPE}"), closure(one(f"head:1-{SCOPE}"), u.edges))


def _dated(u: Universe) -> Universe:
    """Finished orders are to be deleted two years after their date."""
    at = F.concat(F.date_format(F.add_months(F.to_date(F.substring("created_at", 1, 10)), 24), "yyyy-MM-dd"), F.lit("T00:00:00.000000000Z"))
    mark = F.when((F.col("type") == "source/order") & (F.try_element_at("fields", F.lit("status")) == "F"), F.map_concat("fields", F.create_map(F.lit("delete_by"), at))).otherwise(F.col("fields"))
    return u.with_(nodes=u.nodes.withColumn("fields", mark), kinds=u.kinds)


DUE = f"SELECT 'order:' || o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND CAST(o_orderdate AS DATE) + INTERVAL 24 MONTH <= DATE '1999-06-30'"


@registered(sql("SELECT c.id FROM c JOIN due USING (id)", reach("c", _ids(f"head:3-{SCOPE}")), f"due AS ({DUE})"))
def deletion_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of a branch whose planned deletion is due."""
    return sync.planned(_dated(ingested(spark, sf_dir)), spark.createDataFrame([(f"head:3-{SCOPE}",)], "id string"), "1999-06-30T00:00:00.000000000Z")


@registered(sql("SELECT id FROM c EXCEPT SELECT id FROM free EXCEPT SELECT id FROM due", reach("c", _ids(f"head:3-{SCOPE}")), f"due AS ({DUE})", f"free(id) AS ({_ids(f'head:3-{SCOPE}')} UNION SELECT e.dst FROM free f JOIN edges e ON e.src = f.id WHERE e.dst NOT IN (SELECT id FROM due))"))
def stranded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that only scheduled ones lead to."""
    u = _dated(ingested(spark, sf_dir))
    heads = spark.createDataFrame([(f"head:3-{SCOPE}",)], "id string")
    return sync.stranded(u, heads, u.nodes.where(sync.due(u.nodes, "1999-06-30T00:00:00.000000000Z")).select("id"))


@registered(sql("SELECT n.type, count(*) AS n FROM nodes n LEFT JOIN edges e ON e.dst = n.id WHERE e.dst IS NULL GROUP BY n.type"))
def open_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that no other references, by type."""
    u = ingested(spark, sf_dir)
    return sync.open_heads(u.nodes, u.edges).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@registered(sql("SELECT type, height, count(*) AS n FROM nodes GROUP BY type, height"))
def heights_recomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights from references alone agree with those stored."""
    u = ingested(spark, sf_dir)
    return sync.heights(u.nodes, u.edges).join(u.nodes.select("id", "type"), "id").groupBy("type", "height").agg(F.count(F.lit(1)).alias("n"))


@registered(sql("SELECT type, count(*) AS n, max(height) AS max_height, CAST(sum(COALESCE(content_size, 0)) AS BIGINT) AS bytes FROM nodes GROUP BY type"))
def type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.histogram(ingested(spark, sf_dir).nodes)


@registered(sql("SELECT f_lang AS value, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM nodes WHERE f_lang IS NOT NULL AND type = 'source/document' GROUP BY f_lang"))
def find_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.by_field(ingested(spark, sf_dir).nodes, "lang", ("source/document",))


@registered("SELECT 'customer:' || user_id AS dst, count(*) AS n FROM events WHERE user_id % 3 = 0 GROUP BY user_id")
def admit_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that events cite beyond what the contribution may read (those whose key three does not divide), with the number of citations."""
    u = ingested(spark, sf_dir)
    own = Universe(u.nodes.where("type = 'source/event'"), u.edges.where("src like 'event:%'"))
    readable = u.nodes.where("type = 'entity/customer' and cast(substring(id, 10) as long) % 3 <> 0").select("id")
    return sync.refused_references(own, readable).groupBy("dst").agg(F.count(F.lit(1)).alias("n"))


def _contributor(u: Universe) -> str:
    return u.nodes.where("type = 'contribution/contributor'").agg(F.min("id")).first()[0]


@registered(sql("SELECT 'contribution/head' AS type, 'contribution/head' AS kind, 'nation:' || n_nationkey AS dst, CAST(2 AS BIGINT) AS height FROM nation UNION ALL SELECT 'contribution/head', 'contribution/contributor', min('contributor:' || source), 2 FROM documents WHERE source IS NOT NULL"))
def consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One head over all nations."""
    u = ingested(spark, sf_dir)
    made = merge.consolidated(u, u.nodes.where("type = 'entity/nation'").select("id"), _contributor(u), "2031-01-01T00:00:00.000000000Z")
    return made.universe.nodes.where(F.col("id") == made.id).join(made.universe.edges.select("src", "dst", F.col("type").alias("kind")), F.col("id") == F.col("src")).select("type", "kind", "dst", "height")


@registered(sql(f"""SELECT 'branch' AS part, name, CASE name WHEN 'new' THEN 'entity/customer' ELSE 'contribution/head' END AS type FROM (SELECT DISTINCT o_orderpriority AS name FROM orders UNION ALL SELECT 'new')
    UNION ALL SELECT 'cited', '{SCOPE}', dst FROM (SELECT 'head:3-{SCOPE}' AS dst UNION ALL SELECT 'order:' || min(o_orderkey) FROM orders WHERE o_orderpriority = '5-LOW')
    UNION ALL SELECT 'table', kind, dst FROM (VALUES ('contribution/diff', '{HEAD}'), ('contribution/branch', 'customer:4')) v(kind, dst)
    UNION ALL SELECT 'again', 'same', 'true'"""))
def merge_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A branch that gets an order which it does not reach and one that it does, and a new branch; merged once more, nothing changes."""
    u, one = ingested(spark, sf_dir), lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderpriority").agg(F.min("o_orderkey").alias("k"))
    first = {r.o_orderpriority: f"order:{r.k}" for r in orders.collect()}
    offered = {SCOPE: one(first["5-LOW"], first[SCOPE]), "new": one("customer:4")}
    made = merge.merged(u, HEAD, offered, _contributor(u), "2031-01-01T00:00:00.000000000Z")
    new = made.universe
    own = new.branches.where(F.col("table_id") == made.id)
    branch = own.join(new.nodes.select(F.col("id").alias("head"), "type"), "head").select(F.lit("branch").alias("part"), "name", "type")
    cited = own.where(F.col("name") == SCOPE).join(new.edges.where("type = 'contribution/head'").select(F.col("src").alias("head"), "dst"), "head").select(F.lit("cited").alias("part"), "name", F.col("dst").alias("type"))
    table = new.edges.where((F.col("src") == made.id) & F.col("dst").isin(HEAD, "customer:4")).select(F.lit("table").alias("part"), F.col("type").alias("name"), F.col("dst").alias("type"))
    again = merge.merged(new, made.id, offered, _contributor(u), "2032-01-01T00:00:00.000000000Z").id == made.id
    return branch.unionByName(cited).unionByName(table).unionByName(spark.createDataFrame([("again", "same", str(again).lower())], "part string, name string, type string"))


@registered(sql("""SELECT 'citing' AS part, p AS name, CASE WHEN dst LIKE 'head:%' THEN dst ELSE 'order' END AS dst, count(*) AS n FROM (SELECT p, 'head:3-' || p AS dst FROM (SELECT DISTINCT o_orderpriority AS p FROM orders)
    UNION ALL SELECT p, 'order:' || o_orderkey FROM orders JOIN (SELECT DISTINCT o_orderpriority AS p FROM orders) ON p <> o_orderpriority WHERE o_orderkey IN (SELECT min(o_orderkey) FROM orders GROUP BY o_orderpriority)) GROUP BY ALL
    UNION ALL SELECT 'diff', NULL, 'table:3', 1 UNION ALL SELECT 'branches', NULL, NULL, count(DISTINCT o_orderpriority) FROM orders"""))
def merge_into_all_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One contribution, each priority's first order, folded into every branch at once: a branch takes the orders that it does not reach."""
    u, orders = ingested(spark, sf_dir), spark.read.parquet(f"{sf_dir}/orders.parquet")
    first = orders.groupBy("o_orderpriority").agg(F.min("o_orderkey").alias("k")).select(F.concat(F.lit("order:"), "k").alias("id"), F.lit(HEAD).alias("table_id"))
    offered = u.branches.where(F.col("table_id") == HEAD).join(first, "table_id").select("name", "id")
    made = merge.merged(u, HEAD, offered, _contributor(u), "2031-01-01T00:00:00.000000000Z")
    own = made.universe.branches.where(F.col("table_id") == made.id)
    cited = own.join(made.new_edges.where("type = 'contribution/head'").select(F.col("src").alias("head"), "dst"), "head")
    cited = cited.groupBy(F.lit("citing").alias("part"), "name", F.when(F.col("dst").like("head:%"), F.col("dst")).otherwise("order").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    diff = made.new_edges.where("type = 'contribution/diff'").select(F.lit("diff").alias("part"), F.lit(None).cast("string").alias("name"), "dst", F.lit(1).cast("long").alias("n"))
    count = made.new_edges.where("type = 'contribution/branch'").agg(F.count(F.lit(1)).alias("n")).select(F.lit("branches").alias("part"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("dst"), "n")
    return cited.unionByName(diff).unionByName(count)


@registered("""WITH d AS (SELECT doc_id, lang, text, doc_id // 50 AS s, (doc_id // 50) % 9 AS f FROM documents WHERE text IS NOT NULL), g AS (SELECT s, f FROM d GROUP BY s, f), ok AS (SELECT * FROM d WHERE f NOT IN (1, 2, 3))
    SELECT 'stream ' || g.s AS name, CASE f WHEN 1 THEN 'other bytes than the address names' WHEN 2 THEN 'a branch that is not declared' WHEN 3 THEN 'not a CBOR sequence' ELSE 'none' END AS fault, CAST((SELECT count(*) FROM ok WHERE ok.s = g.s) AS BIGINT) AS n FROM g
    UNION ALL SELECT 'claims in ' || COALESCE(lang, 'und'), 'none', count(DISTINCT doc_id) FROM ok GROUP BY lang UNION ALL SELECT 'content bytes', 'none', CAST(sum(n) AS BIGINT) FROM (SELECT strlen(text) AS n FROM ok GROUP BY text)""")
def contribution_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as streams of fifty, each a claim and its text as content: what streams without a fault bring, and where the others end. Some have changed bytes, some name a branch that they did not declare, some are cut."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select("doc_id", F.floor(F.col("doc_id") / 50).cast("long").alias("s"), F.coalesce("lang", F.lit("und")).alias("lang"), "text")

    def write(batches):
        import itertools

        import pyarrow as pa

        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for s, own in itertools.groupby(rows, key=lambda row: row[1]):
            parts, kind = [contributions.declaring(["docs"], ["$universe"])], s % 9
            for doc, _, lang, text in own:
                body = text.encode()
                node = {"type": "source/document", "type_class": "source", "type_sub": "document", "created_at": BASE_TEXT, "height": 0, "encoding": "text/plain", "content_hash": ids.address(body), "content_size": len(body), "fields": {"lang": lang, "number": str(doc)}}
                content = contributions.content_record(body)
                parts += [contributions.claim_record(wire.encode_claim(node, []), "other" if kind == 2 else "docs"), content[:-1] + bytes([content[-1] ^ 1]) if kind == 1 and body else content]
            stream = b"".join(parts)
            yield pa.RecordBatch.from_pydict({"path": pa.array([f"stream {s}"]), "content": pa.array([stream[:-1] if kind == 3 else stream], pa.binary())})

    files = docs.repartition("s").sortWithinPartitions("s", "doc_id").mapInArrow(write, "path string, content binary")
    got = contributions.taken(files)
    per = got.claims().groupBy(F.col("path").alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("fault", F.lit("none"))
    broken = got.faults.select(F.col("path").alias("name"), "fault", F.lit(0).cast("long").alias("n"))
    langs = got.nodes().groupBy(F.concat(F.lit("claims in "), F.col("fields").getField("lang")).alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("fault", F.lit("none"))
    size = got.contents().agg(F.sum(F.length("bytes")).cast("long").alias("n")).select(F.lit("content bytes").alias("name"), F.lit("none").alias("fault"), "n")
    return per.select("name", "fault", "n").unionByName(broken).unionByName(langs.select("name", "fault", "n")).unionByName(size)


_FIRST_LAST = "(SELECT o_orderpriority AS p, min(o_orderkey) AS k FROM orders GROUP BY 1 UNION SELECT o_orderpriority, max(o_orderkey) FROM orders GROUP BY 1)"


@registered(sql(f"""SELECT name, id FROM (SELECT p AS name, 'order:' || k AS id FROM {_FIRST_LAST} UNION SELECT p, 'customer:' || o_custkey FROM {_FIRST_LAST} JOIN orders ON o_orderkey = k
    UNION SELECT p, 'nation:' || c_nationkey FROM {_FIRST_LAST} JOIN orders ON o_orderkey = k JOIN customer ON c_custkey = o_custkey UNION SELECT p, 'region:' || n_regionkey FROM {_FIRST_LAST} JOIN orders ON o_orderkey = k JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
    UNION SELECT p, (SELECT min('contributor:' || source) FROM documents) FROM {_FIRST_LAST} UNION SELECT 'places', 'nation:3' UNION SELECT 'places', 'region:' || n_regionkey FROM nation WHERE n_nationkey = 3)
    UNION ALL SELECT 'claims', CAST(count(*) AS VARCHAR) FROM nodes WHERE type IN ('entity/region', 'entity/nation', 'entity/customer', 'source/order', 'contribution/contributor') UNION ALL SELECT 'snapshots', '2'"""))
def snapshot_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive on disk after two commits, the second one of two contributions that share claims with the first: what its branches hold, and how many claims it has."""
    u, place = ingested(spark, sf_dir), snapshots.Store(spark, scratch(spark, "archive"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_orderpriority").alias("name")).agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b"))
    ends = orders.select("name", F.explode(F.array("a", "b")).alias("k")).select("name", F.concat(F.lit("order:"), F.col("k").cast("string")).alias("id"))

    def part(heads: DataFrame, *types: str) -> snapshots.Contribution:
        nodes = u.nodes.where(F.col("type").isin(*types))
        return snapshots.Contribution(nodes, u.edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi"), heads)

    places = part(spark.createDataFrame([("places", "nation:3")], "name string, id string"), "entity/region", "entity/nation", "contribution/contributor")
    people, bought = part(ends.limit(0), "entity/nation", "entity/customer"), part(ends, "entity/customer", "source/order")
    place.commit([places], _contributor(u), "2031-01-01T00:00:00.000000000Z")
    last = place.commit([people, bought], _contributor(u), "2032-01-01T00:00:00.000000000Z")
    new = place.universe()
    heads = new.branches.where(F.col("table_id") == last.head).select(F.lit("t").alias("table"), F.lit(0).cast("long").alias("height"), "name", "head")
    held = tags.joined_at(heads, new.edges).select(F.substring("key", len(tags.PREFIX) + 1, 1 << 20).alias("name"), "id").join(u.nodes.select("id"), "id", "left_semi").select("name", "id")
    count = new.nodes.where(~F.col("type").isin("contribution/head", "contribution/branches")).agg(F.count(F.lit(1)).cast("string").alias("id")).select(F.lit("claims").alias("name"), "id")
    return held.unionByName(count).unionByName(spark.createDataFrame([("snapshots", str(last.number))], "name string, id string"))


@registered("SELECT 'customer:' || c_custkey AS id, 'head:' || r || '-' || p AS head, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = p AND " + BUCKET + " <= r) AS member FROM (SELECT c_custkey, c_custkey % 3 + 1 AS r FROM customer), (SELECT DISTINCT o_orderpriority AS p FROM orders)")
def membership_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer and each head of one of the three revisions, whether the head's closure holds the customer: no closure is walked."""
    u = ingested(spark, sf_dir)
    customers = u.nodes.where("type = 'entity/customer'").select("id", F.concat(F.lit("table:"), (F.substring("id", 10, 20).cast("long") % 3 + 1).cast("string")).alias("table_id"))
    return membership.members(customers.join(u.branches, "table_id").select("id", "head"), u.nodes, u.edges, u.kinds)


@registered("SELECT source AS hash, CAST(min(doc_id) AS BIGINT) AS first FROM documents WHERE source IS NOT NULL GROUP BY source")
def distinct_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External contents by their first appearance: here a document's content is named by its source."""
    return sync.distinct_contents(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("position"), F.col("source").alias("content_hash")))


@registered(sql("SELECT 'node' AS part, id FROM a UNION ALL SELECT 'reference', src || '>' || dst FROM edges WHERE src IN (SELECT id FROM a)", reach("a", _ids(f"head:2-{SCOPE}"))))
def copy_into_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store with one head's closure gets another's: its claims and references afterwards."""
    u = ingested(spark, sf_dir)
    one = lambda x: spark.createDataFrame([(x,)], "id string")
    held = closure(one(f"head:1-{SCOPE}"), u.edges)
    target = Universe(u.nodes.join(held, "id", "left_semi"), u.edges.join(held.withColumnRenamed("id", "src"), "src", "left_semi"))
    out = sync.copy_closure(u, target, one(f"head:2-{SCOPE}"))
    return out.nodes.select(F.lit("node").alias("part"), "id").unionByName(out.edges.select(F.lit("reference").alias("part"), F.concat_ws(">", "src", "dst").alias("id")))


# Verification
@registered(sql("SELECT e.src AS id, 'created_at' AS rule, e.dst AS detail FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE a.created_at < b.created_at"))
def verify_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims dated before what they reference: line items shipped before their order's date."""
    return verify.monotone(ingested(spark, sf_dir))


@registered(sql("SELECT n.id, 'signer' AS rule, '0 contributors' AS detail FROM nodes n WHERE n.id IN (SELECT src FROM edges) AND n.id NOT IN (SELECT src FROM edges WHERE type = 'contribution/contributor')"))
def verify_signer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that reference others but no contributor: all but documents and initial claims."""
    return verify.signed(ingested(spark, sf_dir))


@registered(sql("SELECT n.id, CASE WHEN n.type = 'relation/lineitem' THEN (SELECT 'part:' || l.l_partkey FROM lineitem l WHERE n.id = " + LINE.replace("l_", "l.l_") + ") WHEN n.id NOT IN (SELECT src FROM edges) THEN n.id ELSE (SELECT dst FROM edges e WHERE e.src = n.id AND e.type = 'contribution/contributor') END AS signer FROM nodes n WHERE n.type NOT LIKE 'contribution/%'"))
def verify_initial_signers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who signs each claim: initial claims, whatever their type, sign themselves; a line item references two contributors, its part and its supplier, of which the first signs."""
    u = ingested(spark, sf_dir)
    u = u.with_(edges=u.edges.withColumn("type", F.when(F.col("type").isin("relation/part", "relation/supplier"), "contribution/contributor").otherwise(F.col("type"))))
    return verify.signers(u, u.nodes.where("type not like 'contribution/%'").select("id")).select("id", "signer")


def _broken(name: str, rule, corrupt, oracle: str) -> None:
    """A rule over claims that a corruption breaks."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rule(corrupt(ingested(spark, sf_dir)))

    QUERIES[name] = run
    SQL[name] = oracle


_broken("verify_height", verify.height, lambda u: u.with_(nodes=u.nodes.withColumn("height", F.col("height") + (F.col("id").rlike("7$") & (F.col("type") == "entity/nation")).cast("long"))),
        sql("SELECT n.id, 'height' AS rule, '2 instead of 1' AS detail FROM nodes n WHERE n.type = 'entity/nation' AND n.id LIKE '%7' UNION ALL SELECT DISTINCT e.src, 'height', '2 instead of 3' FROM edges e JOIN nodes n ON n.id = e.dst WHERE n.type = 'entity/nation' AND n.id LIKE '%7'"))
_broken("verify_direction", verify.direction, lambda u: u.with_(edges=u.edges.withColumn("relation_direction", F.when(F.col("dst") == "part:5", 0).otherwise(F.col("relation_direction")).cast("tinyint"))),
        sql("SELECT src AS id, 'direction' AS rule, '0' AS detail FROM edges WHERE dst = 'part:5'"))
_broken("verify_type_classes", verify.type_classes, lambda u: u.with_(nodes=u.nodes.withColumn("type_class", F.when(F.col("type") == "entity/region", "place").otherwise(F.col("type_class")))),
        sql("SELECT id, 'type' AS rule, type AS detail FROM nodes WHERE type = 'entity/region'"))
_broken("verify_table_reference", verify.table_reference, lambda u: u.with_(edges=u.edges.withColumn("type", F.when(F.col("type") == "contribution/diff", "contribution/head").otherwise(F.col("type")))),
        "SELECT 'table:' || r AS id, 'table_reference' AS rule, 'table:' || (r - 1) AS detail FROM (VALUES (2), (3)) v(r)")
_broken("verify_content_encoding", verify.content_encoding, lambda u: u.with_(nodes=u.nodes.withColumn("content", F.when(F.col("type") == "derivation/label", F.lit("x").cast("binary")))),
        "SELECT 'label:' || doc_id AS id, 'encoding' AS rule, 'content without encoding' AS detail FROM labels")
_broken("verify_delete_by", verify.delete_by, _dated, sql("SELECT e.src AS id, 'delete_by' AS rule, e.dst AS detail FROM edges e JOIN orders ON e.dst = 'order:' || o_orderkey WHERE o_orderstatus = 'F'"))
_broken("verify_structural", verify.structure_kept, lambda u: u.with_(nodes=u.nodes.withColumn("fields", F.map_concat("fields", F.create_map(F.lit("delete_by"), F.lit("2030-01-01T00:00:00.000000000Z"))))),
        sql("SELECT id, 'structural' AS rule, type AS detail FROM nodes WHERE type IN ('contribution/contributor', 'contribution/branches', 'contribution/head')"))


@registered(sql("SELECT e.src AS id, 'gap' AS rule, e.dst AS detail FROM edges e JOIN c ON c.id = e.src WHERE e.dst LIKE 'nation:%'", reach("c", _ids(f"head:1-{SCOPE}"))))
def verify_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to nations, which were taken out of the store without a trace."""
    u = ingested(spark, sf_dir)
    return verify.unexplained(u.with_(nodes=u.nodes.where("type <> 'entity/nation'")), spark.createDataFrame([(f"head:1-{SCOPE}",)], "id string"))


@registered("SELECT 'order:' || o_orderkey AS id, o.dated, epoch_ms(CAST(date_trunc('month', o_orderdate) AS TIMESTAMP)) AS dated_start_ms, epoch_ms(CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS TIMESTAMP)) AS dated_end_ms, (epoch_ms(CAST(date_trunc('month', o_orderdate) AS TIMESTAMP)) + epoch_ms(CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS TIMESTAMP))) // 2 AS dated_mid_ms FROM (SELECT *, strftime(o_orderdate, '%Y-%m') AS dated FROM orders) o")
def temporal_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months as spans of milliseconds, with their midpoints."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = orders.select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("id"), F.date_format("o_orderdate", "yyyy-MM").alias("dated"))
    return edtf.with_spans(rows)


_broken("verify_first_table", verify.first_table, lambda u: u.with_(edges=u.edges.withColumn("type", F.when(F.col("src") == "table:2", "contribution/contributor").otherwise(F.col("type")))),
        "SELECT 'table:2' AS id, 'first_table' AS rule, '6' AS detail")
_broken("verify_edge_order", verify.edge_order, lambda u: u.with_(edges=u.edges.where("src like 'lineitem:%'").withColumn("ord", F.when(F.col("type") == "derivation/order", 0).when(F.col("type") == "relation/supplier", 1).otherwise(2)).withColumn("edge_id", F.regexp_replace("type", "/", ""))),
        sql("SELECT src AS id, 'edge_order' AS rule, 'relationpart' AS detail FROM edges WHERE type = 'relation/part'"))
_broken("verify_delete_target", verify.delete_target, lambda u: u.with_(nodes=u.nodes.withColumn("type", F.when(F.col("type") == "derivation/label", "contribution/delete").otherwise(F.col("type"))), edges=u.edges.withColumn("type", F.when(F.col("src").rlike("^label:.*[0-4]$"), "contribution/delete").otherwise(F.col("type")))),
        "SELECT 'label:' || doc_id AS id, 'delete_target' AS rule, 'no reference' AS detail FROM labels WHERE doc_id % 10 > 4")


def _address(text: str) -> str:
    """SQL of a text's address: base 32 of its multihash, five bits at a time."""
    bits = f"array_to_string(list_transform(string_split('1220' || sha256({text}), ''), lambda d: right(bin(16 + instr('0123456789abcdef', d) - 1), 4)), '') || '000'"
    digit = "1 + list_reduce(list_transform(string_split(substr(b, CAST(5 * i + 1 AS BIGINT), 5), ''), lambda x: CAST(x AS BIGINT)), lambda x, y: 2 * x + y)"
    return f"'b' || (SELECT array_to_string(list_transform(range(55), lambda i: substr('abcdefghijklmnopqrstuvwxyz234567', {digit}, 1)), '') FROM (SELECT {bits} AS b))"


@registered(f"SELECT 'doc:' || doc_id AS id, 'content' AS rule, {_address('text')} AS detail FROM documents WHERE text IS NOT NULL AND length(text) % 5 <= 2")
def verify_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose content is their text, stored once: some are stored with other bytes, some are not stored, some state another size."""
    u, docs = ingested(spark, sf_dir), spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    bytes_, kind = F.encode("text", "UTF-8"), F.length("text") % 5
    own = addressed(docs.select(F.concat(F.lit("doc:"), "doc_id").alias("id"), bytes_.alias("bytes"), kind.alias("kind")), "bytes")
    nodes = own.select("id", F.lit(None).cast("binary").alias("content"), F.col("address").alias("content_hash"), (F.length("bytes") + (F.col("kind") == 2).cast("int")).cast("long").alias("content_size"))
    contents = own.where("kind <> 1").select(F.col("address").alias("hash"), F.when(F.col("kind") == 0, F.encode(F.lit("other"), "UTF-8")).otherwise(F.col("bytes")).alias("bytes")).dropDuplicates(["hash"])
    return verify.content_integrity(u.with_(nodes=nodes, edges=u.edges.where("src is null"), contents=contents))


@registered(f"""SELECT {_address('text')} AS hash, CASE length(text) % 5 WHEN 1 THEN 'chunk 1 is missing' WHEN 2 THEN 'chunk 1 stands twice' WHEN 3 THEN (n - 1) || ' bytes instead of ' || n ELSE 'other bytes' END AS fault
    FROM (SELECT DISTINCT text, strlen(text) AS n FROM documents WHERE strlen(text) > 300) WHERE length(text) % 5 IN (1, 2, 3, 4)""")
def verify_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as contents in chunks of a hundred bytes, of which some lack a chunk, some have one twice, some have lost their last byte and some have other bytes in a chunk."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("octet_length(text) > 300").select("text").distinct()
    own = addressed(docs.select(F.encode("text", "UTF-8").alias("bytes"), (F.length("text") % 5).alias("kind")), "bytes")
    kinds = own.select(F.col("address").alias("hash"), "kind", F.length("bytes").cast("long").alias("size"))
    parts = chunks.chunked(own.select(F.col("address").alias("hash"), "bytes"), 100).join(kinds, "hash")
    kind, second, last = F.col("kind"), F.col("position") == 1, (F.col("position") + 1) * 100 >= F.col("size")
    # an added space is a byte like others: the size stays where the first byte goes
    changed = F.when((kind == 3) & last, F.expr("substring(bytes, 1, length(bytes) - 1)")).when((kind == 4) & second, F.concat(F.expr("substring(bytes, 2, length(bytes) - 1)"), F.unhex(F.lit("00")))).otherwise(F.col("bytes"))
    copies = F.when((kind == 1) & second, F.array().cast("array<int>")).when((kind == 2) & second, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0)))
    stored_ = parts.select("hash", "position", changed.alias("bytes"), F.explode(copies))
    return chunks.faults(stored_, kinds.select("hash", "size"))


@registered(f"""SELECT 'label:' || doc_id AS id, 'content' AS rule, {_address("'q' || quality")} AS detail FROM labels WHERE doc_id % 3 = 0 UNION ALL SELECT 'label:' || doc_id, 'encoding', 'content without encoding' FROM labels WHERE doc_id % 2 = 0
    UNION ALL SELECT 'doc:' || doc_id, 'content', {_address("source")} FROM documents WHERE source IS NOT NULL AND doc_id % 7 = 0 UNION ALL SELECT 'doc:' || doc_id, 'encoding', 'content without encoding' FROM documents WHERE source IS NOT NULL AND doc_id % 2 = 0""")
def verify_contents_of_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of references: a label's of its document has the quality within, some of it changed; a document's of its source states the address of a stored content, and some a false size. Every second one has no encoding."""
    u = ingested(spark, sf_dir)
    key = F.regexp_extract("src", r"(\d+)$", 1).cast("long")
    quality = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.concat(F.lit("label:"), "doc_id").alias("src"), F.concat(F.lit("q"), "quality").alias("said"))
    refs = u.edges.where("src like 'label:%' or (src like 'doc:%' and type = 'contribution/contributor')").join(quality, "src", "left")
    said = F.encode(F.coalesce("said", F.substring("dst", len("contributor:") + 1, 1 << 20)), "UTF-8")
    inline, changed = F.col("src").like("label:%"), F.when(key % 3 == 0, F.encode(F.lit("other"), "UTF-8")).otherwise(said)
    refs = refs.withColumn("content_hash", address_column(said)).withColumn("content", F.when(inline, changed)).withColumn("content_size", F.when(inline, F.length(changed)).otherwise(F.length(said) + (key % 7 == 0).cast("int")).cast("long"))
    refs = refs.withColumn("encoding", F.when(key % 2 == 1, F.lit("text/plain"))).select(*u.edges.columns)
    sources = spark.read.parquet(f"{sf_dir}/documents.parquet").where("source is not null").select(F.encode("source", "UTF-8").alias("bytes")).distinct()
    broken = u.with_(nodes=u.nodes.where("id is null"), edges=refs, contents=addressed(sources, "bytes").select(F.col("address").alias("hash"), "bytes"))
    return verify.content_integrity(broken).unionByName(verify.content_encoding(broken))
_broken("verify_archive_head", lambda u: verify.archive_head(u, "order:1").unionByName(verify.archive_head(u, "nothing")).unionByName(verify.archive_head(u, HEAD)), lambda u: u,
        "SELECT * FROM (VALUES ('order:1', 'archive_head', 'source/order'), ('nothing', 'archive_head', 'not stored')) v(id, rule, detail)")


def _keys(u: Universe) -> Universe:
    """Orders signed by their customers, whose keys hold from 1994 on, and of every third customer until 1997."""
    key = F.create_map(F.lit("pubkey_valid_from"), F.lit("1994-01-01T00:00:00.000000000Z"))
    ends = F.create_map(F.lit("pubkey_expires_after"), F.lit("1997-01-01T00:00:00.000000000Z"))
    fields = F.when(F.col("type") == "entity/customer", F.when(F.substring("id", 10, 20).cast("long") % 3 == 0, F.map_concat(key, ends)).otherwise(key)).otherwise(F.create_map().cast("map<string,string>"))
    return u.with_(nodes=u.nodes.withColumn("fields", fields), edges=u.edges.withColumn("type", F.when(F.col("src").like("order:%"), "contribution/contributor").otherwise(F.col("type"))))


_broken("verify_key_window", verify.key_window, _keys, "SELECT 'order:' || o_orderkey AS id, 'key_window' AS rule, 'customer:' || o_custkey AS detail FROM orders WHERE o_orderdate < DATE '1994-01-01' OR (o_custkey % 3 = 0 AND o_orderdate > DATE '1997-01-01')")


_REVOKED = "SELECT user_id, min(DATE '1993-01-01' + CAST(event_id % 2000 AS INTEGER)) AS ended FROM events WHERE event_id % 2 = 0 GROUP BY user_id"


@registered(f"""SELECT 'order:' || o_orderkey AS id, 'key_window' AS rule, CASE WHEN o_custkey % 11 = 0 THEN 'pubkey_expires_after=soon' ELSE 'customer:' || o_custkey END AS detail
    FROM orders LEFT JOIN ({_REVOKED}) ON user_id = o_custkey WHERE o_custkey % 11 = 0 OR o_custkey % 7 = 0 OR o_orderdate > ended""")
def verify_revoked_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders signed by customers, whose keys events revoke as of the date that their reference states. Only events in the closure of the roots count, here every second one. Customers sign themselves; some state a key
    of the future, by which their own claim is not judged, some a date that can't be read."""
    u = ingested(spark, sf_dir)
    key = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    states = F.when(key % 11 == 0, F.create_map(F.lit("pubkey_expires_after"), F.lit("soon"))).when(key % 7 == 0, F.create_map(F.lit("pubkey_valid_from"), F.lit("2030-01-01T00:00:00.000000000Z"))).otherwise(F.create_map().cast("map<string,string>"))
    nodes = u.nodes.where("type in ('entity/customer', 'source/order', 'source/event')").withColumn("fields", F.when(F.col("type") == "entity/customer", states).otherwise(F.create_map().cast("map<string,string>")))
    event = F.regexp_extract("src", r"(\d+)$", 1).cast("long")
    date = F.date_format(F.date_add(F.lit("1993-01-01").cast("date"), (event % 2000).cast("int")), "yyyy-MM-dd'T'00:00:00.000000000'Z'")
    edges = u.edges.where("src like 'order:%' or src like 'event:%'")
    edges = edges.withColumn("fields", F.when(F.col("src").like("event:%"), F.create_map(F.lit("pubkey_expires_after"), date)).otherwise(F.col("fields"))).withColumn("type", F.when(F.col("src").like("event:%"), "contribution/expiry").otherwise("contribution/contributor"))
    roots = nodes.where((F.col("type") == "source/order") | ((F.col("type") == "source/event") & (key % 2 == 0))).select("id")
    return verify.key_window(u.with_(nodes=nodes, edges=edges), roots)


@registered("SELECT CASE WHEN doc_id % 4 = 0 THEN 'b' || doc_id END AS forged, count(*) AS n FROM documents WHERE doc_id % 4 = 0 GROUP BY 1")
def verify_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose id is not their address: every fourth has a false one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("envelope"))
    raw = addressed(docs, "envelope").select(F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("b"), F.col("doc_id").cast("string"))).otherwise(F.col("address")).alias("id"), "envelope")
    empty_ = ingested(spark, sf_dir)
    return verify.raw_ids(empty_.with_(raw=raw)).groupBy(F.col("id").alias("forged")).agg(F.count(F.lit(1)).alias("n"))


@registered(sql("""SELECT id, rule, count(*) AS n FROM (SELECT n.id, CASE WHEN n.height <> CASE WHEN n.type = 'entity/nation' THEN 1 ELSE 0 END THEN 'height' WHEN n.type = 'entity/nation' THEN 'signer' END AS rule FROM (SELECT id, type, height + (id LIKE '%7')::INTEGER AS height FROM nodes WHERE type IN ('entity/nation', 'entity/region')) n) WHERE rule IS NOT NULL GROUP BY id, rule"""))
def violations_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several rules that a claim breaks the first one is reported."""
    u = ingested(spark, sf_dir)
    u = u.with_(nodes=u.nodes.where("type in ('entity/nation', 'entity/region')").withColumn("height", F.col("height") + F.col("id").rlike("7$").cast("long")), edges=u.edges.where("type = 'derivation/region'"))
    return verify.violations(u).groupBy("id", "rule").agg(F.count(F.lit(1)).alias("n"))


@registered("SELECT 'nation:' || n_nationkey AS id, 'signature' AS rule, CASE n_nationkey % 5 WHEN 0 THEN 'not the signer''s' ELSE 'not an envelope' END AS detail FROM nation WHERE n_nationkey % 5 < 2")
def verify_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as signed envelopes of their names: some carry another name than the one signed, some are cut."""
    seed, other = b"a seed of 32 bytes for this query"[:32], b"another seed, of somebody else..."[:32]
    u = ingested(spark, sf_dir)
    contributor = _contributor(u)
    rows = [(f"nation:{r.n_nationkey}", r.n_nationkey % 5, r.n_name.encode()) for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").collect()]
    raw = spark.createDataFrame([(i, signatures.sealed(other if k == 0 else seed, name)[: -1 if k == 1 else None]) for i, k, name in rows], "id string, envelope binary")
    key = F.when(F.col("id") == contributor, F.lit(signatures.KEY_CODE + signatures.public_key(seed)))
    edges = u.edges.where("src like 'nation:%'").withColumn("type", F.lit("contribution/contributor")).withColumn("dst", F.lit(contributor))
    return verify.signatures(u.with_(nodes=u.nodes.where("type in ('entity/nation', 'contribution/contributor')").withColumn("content", key), edges=edges, raw=raw))


@registered("SELECT 'supplier:' || s_suppkey AS id, 'signature' AS rule, CASE WHEN s_suppkey % 10 = 3 THEN 'not an envelope' ELSE 'not the signer''s' END AS detail FROM supplier WHERE s_suppkey % 10 IN (3, 6) OR s_nationkey = 7")
def verify_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as envelopes of their names, signed on the executors by the contributors of their nations: every tenth is cut, another tenth names another supplier than was signed, and one nation signs with another key
    than its contributor states."""
    u, suppliers = ingested(spark, sf_dir), spark.read.parquet(f"{sf_dir}/supplier.parquet")
    seed = lambda n: F.unhex(F.sha2(F.concat(F.lit("seed of "), n.cast("string")), 256))
    key = F.col("s_suppkey") % 10
    rows = suppliers.select("s_suppkey", "s_nationkey", seed(F.when(F.col("s_nationkey") == 7, -1).otherwise(F.col("s_nationkey"))).alias("seed"), F.encode("s_name", "UTF-8").alias("payload"))
    raw = signatures.signed(rows, "seed", "payload")
    # the last 70 bytes begin with the payload's end: a changed letter there is another name under the same signature
    other = F.concat(F.expr("substring(envelope, 1, length(envelope) - 67)"), F.unhex(F.lit("5A")), F.expr("substring(envelope, length(envelope) - 65, 66)"))
    raw = raw.select(F.concat(F.lit("supplier:"), "s_suppkey").alias("id"), F.when(key == 3, F.expr("substring(envelope, 1, length(envelope) - 1)")).when(key == 6, other).otherwise(F.col("envelope")).alias("envelope"))
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("nation:"), "n_nationkey").alias("id"), seed(F.col("n_nationkey")).alias("seed"))
    nodes = u.nodes.where("type in ('entity/nation', 'entity/supplier')").drop("content").join(signatures.keyed(nations, "seed").select("id", F.col("key").alias("content")), "id", "left").select(*u.nodes.columns)
    edges = u.edges.where("src like 'supplier:%'").withColumn("type", F.lit("contribution/contributor"))
    return verify.signatures(u.with_(nodes=nodes, edges=edges, raw=raw))


_FROM_SCOPE = f"SELECT DISTINCT c_custkey, c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = '{SCOPE}' AND c_custkey % 2 = 1 AND c_nationkey % 10 = 7"


@registered(f"SELECT 'customer:' || c_custkey AS id, 1 AS depth, 'height' AS rule, '2 instead of 3' AS detail FROM ({_FROM_SCOPE}) UNION ALL SELECT DISTINCT 'nation:' || c_nationkey, 2, 'height', '2 instead of 1' FROM ({_FROM_SCOPE})")
def verification_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run from a priority's orders, two references deep, that trusts every second customer; some nations have a false height."""
    u = ingested(spark, sf_dir)
    u = u.with_(nodes=u.nodes.withColumn("height", F.col("height") + (F.col("id").rlike("7$") & (F.col("type") == "entity/nation")).cast("long")))
    roots = u.nodes.where((F.col("type") == "source/order") & (F.try_element_at("fields", F.lit("priority")) == SCOPE)).select("id")
    trusted = u.nodes.where("type = 'entity/customer' and cast(substring(id, 10) as long) % 2 = 0").select("id")
    skip = tuple(r.__name__ for r in verify.RULES if r is not verify.height)
    return verification.verified(u, roots, verification.Options(depth=2, trusted=trusted, skip=skip))


@registered(f"SELECT 'nation:' || n_nationkey AS id, 3 AS depth, 'gap' AS rule, 'not stored' AS detail FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = '{SCOPE}' AND year(o_orderdate) <= 1996) ORDER BY id LIMIT 4")
def verification_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four failures of a run in a store without nations."""
    u = ingested(spark, sf_dir)
    roots = spark.createDataFrame([(f"head:1-{SCOPE}",)], "id string")
    return verification.verified(u.with_(nodes=u.nodes.where("type <> 'entity/nation'")), roots, verification.Options(stop_after=4, skip=tuple(r.__name__ for r in verify.RULES)))


@registered("""SELECT 'region:' || r_regionkey AS id, r.rule, 'entity/region' AS detail FROM region, (VALUES ('content_twice'), ('encoding_missing')) r(rule) UNION ALL SELECT 'nation:' || n_nationkey, 'field_name', 'entity/nation' FROM nation WHERE n_nationkey % 5 = 0
    UNION ALL SELECT 'customer:' || c_custkey, 'encoding_alone', 'entity/customer' FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'customer:' || c_custkey, r.rule, 'entity/customer' FROM customer, (VALUES ('encoding_alone'), ('encoding_form')) r(rule) WHERE c_custkey % 2 = 1
    UNION ALL SELECT 'nation:' || n_nationkey, 'single', 'contribution/contributor' FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'edge_name', 'twice' FROM customer""")
def construction_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New claims that break rules of their making: contents, encodings, fields, and references that stand twice."""
    u = ingested(spark, sf_dir)
    kind, key = F.col("type"), F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    nodes = u.nodes.where("type in ('entity/region', 'entity/nation', 'entity/customer')")
    nodes = nodes.withColumn("content", F.when(kind == "entity/region", F.lit(b"x"))).withColumn("content_hash", F.when(kind == "entity/region", F.lit("h")))
    nodes = nodes.withColumn("encoding", F.when(kind == "entity/customer", F.when(key % 2 == 0, "text/plain").otherwise("text of a kind")))
    nodes = nodes.withColumn("fields", F.when((kind == "entity/nation") & (key % 5 == 0), F.create_map(F.lit("Bad name"), F.lit("x"))).otherwise(F.col("fields")))
    edges = u.edges.where("src like 'nation:%' or src like 'customer:%'").select(*(c for c in u.edges.columns if c != "_copy"), F.explode(F.array(*map(F.lit, range(3)))).alias("_copy"))
    customer = F.col("src").like("customer:%")
    edges = edges.where("src like 'customer:%' or _copy < 2").withColumn("type", F.when(~customer, "contribution/contributor").when(F.col("_copy") == 0, "contribution/diff").otherwise("derivation/nation"))
    edges = edges.withColumn("type_class", F.substring_index("type", "/", 1)).withColumn("type_sub", F.substring_index("type", "/", -1)).withColumn("fields", F.create_map(F.lit("name"), F.lit("twice")))
    return construct.refused(u.with_(nodes=nodes, edges=edges.drop("_copy")))


@registered(sql("SELECT id, upper(hex(encode(id || '|' || type))) AS envelope, 'claim_envelope' AS kind FROM nodes WHERE type IN ('source/order', 'entity/customer') AND id IN (SELECT id FROM c)", reach("c", _ids(f"head:1-{SCOPE}"))))
def envelope_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored envelopes of a branch's orders and customers, byte for byte."""
    u = ingested(spark, sf_dir)
    raw = u.nodes.select("id", F.encode(F.concat_ws("|", "id", "type"), "UTF-8").alias("envelope"))
    q = Query("$universe", head=f"head:1-{SCOPE}", where=Where(any=(leaf("type", "eq", "source/order"), leaf("type", "eq", "entity/customer"))), output=Output(detail="envelope"))
    return Archive(u.with_(raw=raw), HEAD).query(q).rows.select("id", F.hex("envelope").alias("envelope"), "kind")


@registered("""WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, left(o_orderpriority, 1) AS name FROM orders)
    SELECT 'order:' || o.o_orderkey AS id, p.name, 'part:' || p.o_orderkey AS dst FROM r o JOIN r p ON p.o_custkey = o.o_custkey AND p.k <= o.k
    WHERE NOT EXISTS (SELECT 1 FROM r q WHERE q.o_custkey = o.o_custkey AND q.k > p.k AND q.k <= o.k AND (q.name = p.name OR (p.name = '1' AND q.name = '5')))""")
def overlay_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named references along the chains of a customer's orders: each order names one by its priority, over those it inherits; low ones omit what is named 1."""
    orders, u = spark.read.parquet(f"{sf_dir}/orders.parquet"), revisions(spark, sf_dir)
    id_, name = F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")), F.left("o_orderpriority", F.lit(1))
    omit = F.map_filter(F.create_map(F.lit("edges_diff_omit"), F.when(name == "5", "1")), lambda k, v: v.isNotNull())
    own = orders.select(id_.alias("src"), F.concat(F.lit("part:"), F.col("o_orderkey").cast("string")).alias("dst"), F.lit("derivation/part").alias("type"), F.create_map(F.lit("name"), name).alias("fields"))
    edges = own.unionByName(u.edges.withColumn("fields", F.create_map().cast("map<string,string>")))
    out = overlay.materialised_edges(orders.select(id_.alias("id"), omit.alias("fields")), edges)
    return out.where("type = 'derivation/part'").select(F.col("src").alias("id"), F.col("fields").getField("name").alias("name"), "dst")


@registered("""SELECT 'customer:' || c_custkey AS id, 'segment' AS key, c_mktsegment AS value FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT 'customer:' || c_custkey, 'nation', CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 <> 0
    UNION ALL SELECT 'customer:' || c_custkey, 'segment_old', c_mktsegment FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'customer:' || c_custkey, 'nation', 'moved' FROM customer WHERE c_custkey % 6 = 0""")
def tags_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of every third customer set anew: those whose key a pattern matches are cleared, others are put over those of the same key."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("id", F.concat(F.lit("customer:"), "c_custkey"))
    held = customer.select("id", F.lit("segment").alias("key"), F.col("c_mktsegment").alias("value")).unionByName(customer.select("id", F.lit("nation").alias("key"), F.col("c_nationkey").cast("string").alias("value")))
    third = customer.where("c_custkey % 3 = 0")
    pairs = third.select("id", F.lit("segment_old").alias("key"), F.col("c_mktsegment").alias("value")).unionByName(third.where("c_custkey % 2 = 0").select("id", F.lit("nation").alias("key"), F.lit("moved").alias("value")))
    return tags.replaced(held, third.select("id"), ("seg*",), pairs)


@registered("SELECT 'order:' || o_orderkey AS id, o_orderkey AS revision FROM orders WHERE o_orderkey < (SELECT max(o_orderkey) // 2 FROM orders) UNION ALL SELECT 'customer:' || c_custkey, (SELECT max(o_orderkey) // 2 FROM orders) + c_custkey - (SELECT min(c_custkey) FROM customer) FROM customer")
def spine_spliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spine of orders, from its middle on replaced by one of customers."""
    orders, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    middle = orders.agg(F.floor(F.max("o_orderkey") / 2).alias("middle"))
    old = orders.select(F.concat(F.lit("order:"), "o_orderkey").alias("id"), F.col("o_orderkey").alias("revision"))
    first = customer.agg(F.min("c_custkey").alias("first"))
    new = customer.join(F.broadcast(first.join(F.broadcast(middle))), F.lit(True)).select(F.concat(F.lit("customer:"), "c_custkey").alias("id"), (F.col("middle") + F.col("c_custkey") - F.col("first")).alias("revision"))  # one row of two numbers
    return tags.spliced(old, new)


def _two_stores(spark: SparkSession, sf_dir: str) -> tuple[Universe, Universe]:
    """Documents with their texts as contents, and a store that holds every second document's claim, no label, and every third text."""
    u, docs = ingested(spark, sf_dir), spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    own = addressed(docs.select(F.concat(F.lit("doc:"), "doc_id").alias("id"), "doc_id", F.encode("text", "UTF-8").alias("bytes")), "bytes")
    nodes = u.nodes.join(own.select("id", F.col("address").alias("_hash")), "id", "left").withColumn("content_hash", F.col("_hash")).select(*u.nodes.columns)
    contents = own.select(F.col("address").alias("hash"), "bytes").dropDuplicates(["hash"])
    source = u.with_(nodes=nodes, contents=contents)
    even = nodes.where("type <> 'derivation/label' and (type <> 'source/document' or cast(substring(id, 5) as long) % 2 = 0)")
    target = u.with_(nodes=even, edges=u.edges.join(even.select(F.col("id").alias("src")), "src", "left_semi"), contents=contents.join(own.where("doc_id % 3 = 0").select(F.col("address").alias("hash")).distinct(), "hash", "left_semi"))
    return source, target


@registered(f"SELECT DISTINCT {_address('text')} AS hash, sha256(text) AS digest, CAST(strlen(text) AS BIGINT) AS size FROM documents WHERE text IS NOT NULL")
def sqlite_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as contents in SQLite files, read in ranges of their addresses. A first commit holds those of even length with other bytes, which the second one mends."""
    path = scratch(spark, "blobs")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    own = addressed(docs.select(F.encode("text", "UTF-8").alias("data")), "data").withColumnRenamed("address", "id")
    blobstores.save(own.where("length(data) % 2 = 0").withColumn("data", F.substring("data", 1, 3)), path)
    blobstores.save(own, path)
    return blobstores.open_blobs(spark, path).select(F.col("id").alias("hash"), F.sha2("data", 256).alias("digest"), F.length("data").cast("long").alias("size"))


@registered(sql("SELECT e.dst AS customer, n.created_at, n.f_status AS status, n.f_priority AS priority, count(*) AS n FROM nodes n JOIN edges e ON e.src = n.id WHERE n.type = 'source/order' GROUP BY ALL"))
def sqlite_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as claims' records in SQLite files, and what their nodes and references say when they are read again; orders that are alike are counted."""
    u, path = universe(spark, sf_dir), scratch(spark, "blobs")
    # from the star schema itself: no closure is asked for, so no other claims are made, nor bands of them
    orders, cited = u.nodes.where("type = 'source/order'"), u.edges.where("type = 'derivation/customer' and src like 'order:%'")
    made = wire.encoded(records(orders.select("id"), orders, cited, None)).select("claim.id", "encoded")
    # records are addressed by what they say, so orders that say the same are one claim
    made = stored(addressed(made, "encoded"))
    blobstores.save(blobstores.records_as_blobs(made), path)
    back = blobstores.open_blobs(spark, path).select("data")
    nodes, edges = wire.nodes_of(back), wire.edges_of(back)
    said = nodes.join(edges.select("src", F.col("dst").alias("customer")), F.col("id") == F.col("src"))
    said = said.select(F.col("id").alias("address"), "customer", "created_at", F.col("fields")["status"].alias("status"), F.col("fields")["priority"].alias("priority"))
    return said.join(made.select("address"), "address").groupBy("customer", "created_at", "status", "priority").agg(F.count(F.lit(1)).alias("n"))


@registered(f"SELECT CAST(l.doc_id AS BIGINT) AS doc_id, {_address('text')} AS hash, CAST(strlen(text) AS BIGINT) AS size FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.toxic = 1 AND text IS NOT NULL")
def sqlite_look_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contents that the claims of toxic documents name, looked up by their addresses in SQLite files with all texts."""
    path = scratch(spark, "blobs")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    own = addressed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("data")), "data").withColumnRenamed("address", "id")
    blobstores.save(own, path)
    toxic = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").select(F.col("doc_id").cast("long").alias("doc_id"))
    named = stored(own.select("doc_id", "id").join(toxic, "doc_id"))
    found = blobstores.looked_up(named, path)
    return named.join(found, "id").select("doc_id", F.col("id").alias("hash"), F.length("data").cast("long").alias("size"))


@registered("SELECT lang, count(DISTINCT text) AS n, CAST(sum(DISTINCT strlen(text)) AS BIGINT) AS distinct_sizes FROM documents WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM documents WHERE text IS NOT NULL AND doc_id % 3 = 0) GROUP BY lang")
def copy_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that a store lacks, by the languages of the documents that have them."""
    source, target = _two_stores(spark, sf_dir)
    lacking = sync.missing_contents(source.contents, target.contents).select("hash", F.length("bytes").alias("size"))
    lang = source.nodes.where("content_hash is not null").select(F.col("content_hash").alias("hash"), F.try_element_at("fields", F.lit("lang")).alias("lang")).distinct()
    return lacking.join(lang, "hash").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum_distinct("size").cast("long").alias("distinct_sizes"))


@registered("""WITH had AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL AND doc_id % 3 = 0), d AS (SELECT DISTINCT doc_id, text FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL)
    SELECT 'doc:' || doc_id AS id, doc_id % 2 = 1 AS new_claim, text NOT IN (SELECT text FROM had) AS new_content FROM d WHERE text IN (SELECT text FROM had UNION SELECT text FROM d WHERE doc_id % 2 = 1)""")
def sync_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store gets the closures of all labels, with the contents of the claims that it did not hold: the documents whose content it has now, and what of them is new."""
    source, target = _two_stores(spark, sf_dir)
    out = sync.copy_closure(source, target, source.nodes.where("type = 'derivation/label'").select("id"), contents=True)
    held = source.nodes.where("type = 'derivation/label'").join(source.edges.select("src", "dst"), F.col("id") == F.col("src")).select(F.col("dst").alias("id"))
    now = out.nodes.where("content_hash is not null").join(held, "id", "left_semi").select("id", F.col("content_hash").alias("hash")).join(out.contents.select("hash"), "hash")
    was = target.nodes.select("id", F.lit(False).alias("new_claim"))
    had = target.contents.select("hash", F.lit(False).alias("new_content"))
    return now.join(was, "id", "left").join(had, "hash", "left").select("id", F.coalesce("new_claim", F.lit(True)).alias("new_claim"), F.coalesce("new_content", F.lit(True)).alias("new_content"))


@registered("SELECT p.name FROM (VALUES ('1-URGENT'), ('new'), ('made')) p(name) WHERE p.name <> 'made' AND p.name NOT IN (SELECT o_orderpriority FROM orders)")
def admit_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches that a contribution may not write: the archive has one of three, and another may be made."""
    held = ingested(spark, sf_dir).branches.where(F.col("table_id") == HEAD)
    return sync.refused_branches(spark.createDataFrame([("1-URGENT",), ("new",), ("made",)], "name string"), held, ("made",))


@registered(sql("SELECT f_lang AS value, id FROM nodes WHERE f_lang IS NOT NULL AND type = 'source/document'"))
def group_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under their language."""
    return sync.grouped(ingested(spark, sf_dir).nodes, "lang", ("source/document",))


@registered("""SELECT doc_id, e.encoding, e.encoding LIKE 'text/%' OR e.encoding LIKE 'message/%' OR e.encoding LIKE '%+json' OR e.encoding LIKE '%+xml' OR e.encoding IN ('application/json', 'application/xml') AS legible
    FROM (SELECT doc_id, ['text/plain', 'message/rfc822', 'application/json', 'application/ld+json', 'image/svg+xml', 'application/jsonx', 'image/png', 'font/woff'][doc_id % 8 + 1] AS encoding FROM documents) e""")
def text_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which media types hold legible text."""
    kinds = F.array(*map(F.lit, ("text/plain", "message/rfc822", "application/json", "application/ld+json", "image/svg+xml", "application/jsonx", "image/png", "font/woff")))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.get(kinds, (F.col("doc_id") % 8).cast("int")).alias("encoding"))
    return docs.withColumn("legible", media.is_text(F.col("encoding")))


@registered("SELECT doc_id, list_reduce(list_prepend('', list_transform(range(1, 51), lambda i: CASE WHEN strlen(left(t, CAST(i AS INTEGER))) <= 50 THEN left(t, CAST(i AS INTEGER)) ELSE '' END)), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END) AS cut FROM (SELECT doc_id, 'é漢😀' || text AS t FROM documents WHERE text IS NOT NULL)")
def text_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut to fifty bytes, at a whole character."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    return docs.select("doc_id", media.cut(F.concat(F.lit("é漢😀"), "text"), 50).alias("cut"))


@registered("SELECT source AS list, CAST(min(doc_id) AS BIGINT) AS first, CAST(max(doc_id) AS BIGINT) AS last FROM documents WHERE source IS NOT NULL GROUP BY source")
def bookmark_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ends of bookmark lists: here a source's documents by their numbers."""
    marks = spark.read.parquet(f"{sf_dir}/documents.parquet").where("source is not null").select(F.col("source").alias("list"), F.col("doc_id").cast("long").alias("idx"))
    return bookmarks.bounds(marks)
