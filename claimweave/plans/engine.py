"""Reads of an archive: scope, walk, filter, order, bound and shape, as one DataFrame plan."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from claimweave import errors
from claimweave.functions import wire
from claimweave.model import Universe
from claimweave.operators import tags
from claimweave.operators.bands import swept
from claimweave.operators.closure import Deadline, closure
from claimweave.operators.kinds import both, references, rows as rows_of
from claimweave.operators.traverse import collected_kinds, walk
from claimweave.plans.predicate import filter_of, may_hold, sort_columns
from claimweave.plans.query import ARCHIVE, CONNECTIONS, UNIVERSE, USES, Content, Query, validate
from claimweave.storage import stored

LEVELS = ("error", "warn", "info", "debug", "trace")


@dataclass
class Event:
    level: str
    step: str
    detail: str
    seconds: float  # since the query began
    rows: int | None = None  # those of the step, where the report counts them


@dataclass
class Report:
    """What a read tells about itself: events up to a level of detail."""

    level: str
    began: float = field(default_factory=time.monotonic)
    events: list[Event] = field(default_factory=list)

    def hears(self, level: str) -> bool:
        return bool(self.level) and LEVELS.index(level) <= LEVELS.index(self.level)

    def say(self, level: str, step: str, detail: str, rows: int | None = None) -> None:
        if self.hears(level):
            self.events.append(Event(level, step, detail, time.monotonic() - self.began, rows))


@dataclass
class Result:
    """rows in order. references: those of the rows' claims, as a table. truncated() is an action."""

    rows: DataFrame
    report: Report
    references: DataFrame | None = None
    bounded: DataFrame | None = None
    limit: int = 0
    late: bool = False

    def truncated(self) -> bool:
        return self.late or bool(self.limit and self.bounded is not None and self.bounded.limit(self.limit + 1).count() > self.limit)


class Archive:
    """An immutable snapshot: a universe and the branch table that heads it."""

    def __init__(self, universe: Universe, head: str | None = None):
        self.universe, self.head = universe, head
        self._closures: dict[str, DataFrame] = {}
        self._known: set[str] = set()
        self._gaps: dict[frozenset[str] | None, DataFrame | None] = {}

    def gaps(self, kinds: frozenset[str] | None = None) -> DataFrame | None:
        """(dst): what is referenced but not stored; None where every reference leads to a claim. kinds: by claims of these types, where that is known. Found once for a snapshot, which never changes."""
        found = self.universe.dangling
        if found is None or "kind" not in found.columns:
            kinds = None
        if kinds not in self._gaps:
            found = self.universe.gaps() if found is None else found if kinds is None else found.where(F.col("kind").isin(sorted(kinds)))
            found = stored(found.select("dst"))
            self._gaps[kinds] = None if found.isEmpty() else found
        return self._gaps[kinds]

    def kinds(self, *ids: str) -> frozenset[str] | None:
        """The types that ids tell; None where nothing is known."""
        return None if self.universe.kinds is None else self.universe.kinds.of(*ids)

    def below(self, *heads: str) -> frozenset[str] | None:
        """The types that the closures of heads may hold."""
        return None if self.universe.kinds is None else self.universe.kinds.reached(self.kinds(*heads))

    def row(self, id_: str) -> DataFrame:
        return rows_of(self.universe.kinds, self.universe.nodes, self.kinds(id_)).where(F.col("id") == id_)

    def required(self, id_: str) -> str:
        """The id itself; NotFound where no such claim is stored."""
        if id_ not in self._known:
            if self.row(id_).select("id").isEmpty():
                raise errors.NotFound(id_)
            self._known.add(id_)
        return id_

    def closure(self, head: str, deadline: Deadline | None = None, strict: bool = True) -> DataFrame:
        """The ids of a claim's closure: walked once for a snapshot. strict: it holds no reference to a claim that is not stored."""
        if head not in self._closures:
            u, start = self.universe, self._id(self.required(head))
            got = closure(start, u.edges, u.max_height, deadline=deadline, known=u.kinds, kinds=self.kinds(head)) if u.bands is None else swept(start, u.bands, deadline, self.below(head))
            if deadline is not None and deadline.late:
                return got  # cut short
            self._closures[head] = got
        found = self._closures[head]
        if strict and (missing := self.gaps(self.below(head))) is not None:
            if not found.join(missing.select(F.col("dst").alias("id")), "id", "left_semi").isEmpty():
                raise errors.DanglingReference(f"the closure of {head} references claims that are not stored")
        return found

    def _id(self, value: str) -> DataFrame:
        return self.universe.nodes.sparkSession.createDataFrame([(value,)], "id string")

    def branches(self) -> DataFrame:
        """(name, head) of the head's branches."""
        return self.universe.branches.where(F.col("table_id") == self.head).select("name", "head").orderBy("name")

    def branch_head(self, name: str) -> str:
        found = self.universe.branches.where((F.col("table_id") == self.head) & (F.col("name") == name)).select("head").take(1)
        if not found:
            raise errors.BranchNotFound(name)
        return found[0].head

    def missing_branches(self, names: list[str]) -> DataFrame:
        return self.universe.nodes.sparkSession.createDataFrame([(n,) for n in names], "name string").join(self.branches(), "name", "left_anti")

    def has_branch(self, name: str) -> bool:
        return not self.universe.branches.where((F.col("table_id") == self.head) & (F.col("name") == name)).isEmpty()

    def previous(self, name: str) -> str | None:
        """The head of a branch's revision before: what its head's diff reference names. None at the first one."""
        found = self.universe.edges.where((F.col("src") == self.branch_head(name)) & (F.col("type") == "contribution/diff")).agg(F.min("dst").alias("dst")).first()
        return found.dst

    def holds(self, branch: str, id_: str, heads: tuple[str, ...] = ()) -> bool:
        """Whether a claim lies within a branch; in $universe, within the closures of the heads given."""
        if branch == UNIVERSE:
            return any(not self.closure(h).where(F.col("id") == id_).isEmpty() for h in heads)
        u = self.universe
        if branch != ARCHIVE and u.tags is not None and tags.tagged(u.tags, branch, id_):
            return True
        return not self.closure(self.head if branch == ARCHIVE else self.branch_head(branch)).where(F.col("id") == id_).isEmpty()

    def get(self, branch: str, id_: str, heads: tuple[str, ...] = ()) -> DataFrame:
        """The one row of a claim within a branch; NotFound elsewhere."""
        if not self.holds(branch, id_, heads):
            raise errors.NotFound(f"{id_} in {branch}")
        return self.row(id_)

    def scope(self, branch: str, deadline: Deadline | None = None) -> tuple[DataFrame | None, str | None]:
        """The ids that a branch confines to (None: all), and its head. Tags answer where the head itself carries the branch's tag."""
        u = self.universe
        if branch == UNIVERSE:
            return None, None
        head = self.head if branch == ARCHIVE else self.branch_head(branch)
        if branch != ARCHIVE and u.tags is not None and tags.tagged(u.tags, branch, head):
            height = self.row(self.head).select("height").first().height
            return tags.members(u.tags, branch, height), head
        found = self.closure(head, deadline)
        if deadline is not None and deadline.late:
            raise errors.TimedOut(f"the scope of {branch} is not known yet")  # only a walk may be answered in part
        return found, head

    def reached(self, q: Query, report: Report, deadline: Deadline | None) -> tuple[DataFrame, frozenset[str] | None]:
        """(id), or (id, route): what the query's scope, head, claim and path reach; and the types that this may be of."""
        u = self.universe
        scope, scope_head = self.scope(q.branch, deadline)
        origin = self.required(q.head) if q.head is not None else scope_head
        if q.claim is not None:
            self.required(q.claim)
        report.say("info", "scope", f"{q.branch} from {origin}")
        ends = None if scope is None else self.below(scope_head)
        if q.head is not None and scope is not None:
            ends = both(ends, self.below(q.head))
        if not q.path:  # the same as one step from 0 hops on, without its levels
            start = self.closure(q.claim if q.claim is not None else origin, deadline)
        elif q.claim is not None:
            start = self._id(q.claim)
        else:
            start = self.closure(origin, deadline)
            start = start if scope is None or q.head is None else start.join(scope, "id", "left_semi")
            if deadline is not None and deadline.late:
                return start.where(F.lit(False)), None  # a frontier in part is no answer
        if q.head is not None and scope is not None:
            scope = scope.join(self.closure(q.head), "id", "left_semi")
        if not q.path:
            whole = scope is None or (q.claim is None and q.head is None)  # the scope's own closure
            return start if whole else start.join(scope, "id", "left_semi"), both(self.below(q.claim if q.claim is not None else origin), ends)
        reverse = any(s.dir in (USES, CONNECTIONS) for s in q.path)
        inside = self.closure(scope_head if scope_head is not None else origin) if reverse else None
        for i, s in enumerate(q.path):
            report.say("debug", "step", f"{i}: {s.dir or 'provenance'} {s.least}..{s.max or ''}")
        first = kinds = self.kinds(q.claim) if q.claim is not None else self.below(origin)
        met = None if u.kinds is None or reverse else u.kinds.reached(first)
        for s in q.path:
            kinds = collected_kinds(u.kinds, s, kinds)
            kinds = kinds if scope is None else both(kinds, ends)
        return walk(start, q.path, u.edges, u.nodes, scope, inside, q.output.shape == "path", deadline, self.gaps(met), u.reverse, u.kinds, first), kinds

    def query(self, q: Query) -> Result:
        """Evaluate a query: traverse, filter, sort, bound, shape.

        A claim named that is not stored is NotFound; a reference to one that the walk arrives at, a DanglingReference. A time limit
        bounds the walk: what the last step has collected by then is the answer, and the result says that it came late.
        """
        validate(q)
        report = Report(q.report)
        deadline = Deadline(q.seconds) if q.seconds else None
        u = self.universe
        ids, kinds = self.reached(q, report, deadline)
        late = deadline is not None and deadline.late
        if late:
            report.say("info", "limit", f"time {q.seconds} s")
        reached, kept, counts = Observation(), Observation(), {}
        if report.hears("debug"):
            ids = ids.observe(reached, F.count(F.lit(1)).alias("n"))
        if kinds is not None:
            kinds = frozenset(k for k in kinds if may_hold(q.where, k) is not False)
        nodes = rows_of(u.kinds, u.nodes, kinds)
        join = lambda ids: nodes.join(ids, "id") if "route" in ids.columns else nodes.join(ids, "id", "left_semi")
        found = join(ids).where(filter_of(q.where))
        if report.hears("debug"):
            # one job walks, filters, counts and writes the ids that the answer then reads: later steps, which may run more than once, count nothing
            found = join(stored(found.observe(kept, F.count(F.lit(1)).alias("n")).select(*ids.columns)))
            counts = {"reached": reached.get["n"], "found": kept.get["n"]}
            report.say("debug", "reached", "claims of the scope or the path", counts["reached"])
        elif q.output.encoding in ("json", "cbor") or q.output.content is not None or q.output.detail == "envelope":
            found = join(stored(found.select(*ids.columns)))  # the claims are read more than once to be shaped
        report.say("info", "filter", "none" if q.where is None else "where", counts.get("found"))
        keys = sort_columns(q.order)
        rows = found.orderBy(*keys).limit(q.results) if q.results else found
        wide, columns = shaped(rows, q, u, kinds)
        returned = min(counts["found"], q.results or counts["found"]) if counts else None
        report.say("info", "results", f"order {len(q.order)} keys, limit {q.results or 'none'}", returned)
        cited = references(u.kinds, u.edges, src=kinds).join(rows.select(F.col("id").alias("src")), "src", "left_semi")
        return Result(wide.orderBy(*keys).select(*columns), report, cited, found, q.results, late)


def size_of(content: str = "content") -> Column:
    return F.coalesce(F.length(content), F.lit(0)).cast("long")


def budget(claims: DataFrame, edges: DataFrame, content: Content | None, keys: tuple[str, ...] = ("ord",)) -> DataFrame:
    """(id, slot, keys, content, content_size): the contents that a claim's cap lets through. keys: what orders a claim's references.

    A cap spans the claim: its references' contents in their order, then its own. The first that does not fit ends the prefix: omit drops it, cutoff
    keeps the bytes that fit. content_size stays the true size. Only claims whose references have more content than the cap need their order.
    """
    last = {k: F.lit(2**31 - 1 if k == "ord" else None).cast(edges.schema[k].dataType).alias(k) for k in keys}
    own = claims.select("id", F.lit("node").alias("slot"), *last.values(), "content", "content_size")
    of = edges.join(claims.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("id"), F.lit("edge").alias("slot"), *keys, "content", "content_size")
    if content is None or content.max == 0:
        every = of.unionByName(own)
        return every if content is not None else every.withColumn("content", F.lit(None).cast("binary"))
    spent = of.groupBy("id").agg(F.sum(size_of()).alias("_spent"))
    cut = lambda room: F.when(room > 0, F.substring("content", F.lit(1), room.cast("int"))) if content.overflow == "cutoff" else F.lit(None).cast("binary")
    fits = lambda before: F.when((size_of() == 0) | (before + size_of() <= content.max), F.col("content")).otherwise(cut(F.lit(content.max) - before))
    node = own.join(spent, "id", "left").withColumn("content", fits(F.coalesce("_spent", F.lit(0)))).drop("_spent")
    counted = of.join(spent, "id")
    before = F.coalesce(F.expr("sum(coalesce(length(content), 0)) over (partition by id order by " + ", ".join(keys) + " rows between unbounded preceding and 1 preceding)"), F.lit(0))
    over = counted.where((F.col("_spent") > content.max) & (size_of() > 0)).withColumn("_before", before).withColumn("content", fits(F.col("_before")))
    whole = counted.where((F.col("_spent") <= content.max) | (size_of() == 0))
    return node.unionByName(whole.select(*node.columns)).unionByName(over.select(*node.columns))


CARRIED = ("encoding", "content_size", "content_hash", "content", "fields")
CLAIM = ("id", "type", "type_class", "type_sub", "created_at", "height", "dated", *CARRIED)


def listed(of: Callable[[str], Column]) -> Column:
    """A reference in a claim's list; of: the reference's columns by name. Lists are in the order of these structs."""
    shown = {"relation_direction": lambda c: c.cast("int"), "fields": lambda c: F.array_sort(F.map_entries(c))}
    return F.struct(of("ord").alias("ord"), of("dst").alias("reference"), *(shown.get(c, lambda x: x)(of(c)).alias(c) for c in ("type", "type_class", "type_sub", "relation_direction", *CARRIED)))


def records(ids: DataFrame, nodes: DataFrame, edges: DataFrame, content: Content | None) -> DataFrame:
    """(id, claim, edges): nodes as structs, with their references in order as an array of structs, contents within the cap. ids: distinct."""
    own = nodes.join(ids.select("id"), "id", "left_semi")
    of = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi")
    if content is None:
        own, of = (d.withColumn("content", F.lit(None).cast("binary")) for d in (own, of))
    elif content.max:
        keys = ("ord", "dst", "type")
        kept = budget(own, of, content, keys).withColumnsRenamed({"id": "_id", "content": "_content", **{k: f"_{k}" for k in keys}}).drop("content_size")
        same = F.col("src") == F.col("_id")
        for k in keys:
            same = same & (F.col(k) == F.col(f"_{k}"))
        of = of.join(kept.where("slot = 'edge'"), same).withColumn("content", F.col("_content"))
        own = own.join(kept.where("slot = 'node'").select("_id", "_content"), F.col("id") == F.col("_id")).withColumn("content", F.col("_content"))
    lists = of.groupBy(F.col("src").alias("_src")).agg(F.array_sort(F.collect_list(listed(F.col))).alias("edges"))
    own = own.join(lists, F.col("id") == F.col("_src"), "left")
    return own.select("id", F.struct(*CLAIM).alias("claim"), F.col("edges"))


def records_of(u: Universe, type_: str, condition: str) -> DataFrame:
    """records() of the claims of a type that meet a condition, without contents. Where rows make their claims with all references and no two rows make the same claim, each is made of its
    row alone, without a shuffle of claims and references."""
    rows = None if u.nested is None or type_ not in u.nested else u.nested[type_].where(condition).where(F.col("id").isNotNull())
    # equal ids have equal hashes; only the hashes travel
    if rows is None or not rows.select(F.xxhash64("id").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return records(u.nodes.where((F.col("type") == type_) & F.expr(condition)).select("id").distinct(), u.nodes, u.edges, None)
    return rows.select("id", F.struct(*CLAIM).alias("claim"), F.array_sort("edges").alias("edges"))


def as_json(claim: str = "claim", edges: str = "edges") -> Column:
    """A claim as JSON text, keys in their order; absent values are left out, contents are base64."""
    value = lambda c: F.col(claim).getField(c)
    some = lambda fields: F.when(F.size(fields) > 0, fields)
    edge = lambda e: F.struct(
        F.base64(e.getField("content")).alias("content"), e.getField("content_hash").alias("content_hash"), e.getField("content_size").alias("content_size"), e.getField("encoding").alias("encoding"), some(F.map_from_entries(e.getField("fields"))).alias("fields"),
        e.getField("reference").alias("reference"), F.when(e.getField("relation_direction") != 0, e.getField("relation_direction")).alias("relation_direction"), e.getField("type").alias("type"),
    )
    return F.to_json(F.struct(
        F.base64(value("content")).alias("content"), value("content_hash").alias("content_hash"), value("content_size").alias("content_size"), value("created_at").alias("created_at"), F.when(F.size(edges) > 0, F.transform(edges, edge)).alias("edges"), value("encoding").alias("encoding"),
        some(F.map_from_entries(F.array_sort(F.map_entries(value("fields"))))).alias("fields"), value("height").alias("height"), value("id").alias("id"), value("type").alias("type"),
    ))


def shaped(rows: DataFrame, q: Query, universe: Universe, kinds: frozenset[str] | None = None) -> tuple[DataFrame, list[Column]]:
    """The output axes: how much of each claim, alone or as its route, in which encoding. Returns rows with what that takes, and the columns to show of them.

    Native rows hold whole contents unless the query states a cap; encoded ones hold none unless it states one. Encoded claims are as they were written where
    the form is not materialized and the deltas are kept. With a route come the claims along it. kinds: the types that rows may be of.
    """
    out, detail = q.output, q.output.detail or "claims"
    route, encoded = out.shape == "path", out.encoding in ("json", "cbor")
    suffix = detail if detail in ("id", "envelope") else "encoded" if encoded else "native"
    kind = F.lit(f"{'path' if route else 'claim'}_{suffix}").alias("kind")
    kinds = None if route else kinds  # what a route leads along is of other types too
    own = lambda table: rows_of(universe.kinds, table, kinds)
    of = lambda edges: references(universe.kinds, edges, src=kinds)
    ids = [F.transform("route", lambda x: x.getField("id")).alias("route")] if route else []
    if detail == "id":
        return rows, [F.col("id"), *ids, kind]
    claims = rows.select(F.explode("route.id").alias("id")).distinct() if route else rows.select("id")
    if detail == "envelope":
        values, shown = own(universe.raw).join(claims, "id", "left_semi").select("id", F.col("envelope").alias("_value")), [F.col("id"), F.col("_value").alias("envelope")]
    elif encoded:
        written = out.form != "materialized" and universe.nodes_delta is not None
        made = records(claims, own(universe.nodes_delta if written else universe.nodes), of(universe.edges_delta if written and universe.edges_delta is not None else universe.edges), out.content)
        values = made.select("id", as_json().alias("_value")) if out.encoding == "json" else wire.encoded(made).select("id", F.col("encoded").alias("_value"))
        shown = [F.col("id"), F.col("_value").alias("encoded")]
    else:
        original = out.form == "original" and universe.nodes_delta is not None
        nodes = universe.nodes_delta if original else universe.nodes
        shown = [F.col("_value").getField(c).alias(c) for c in nodes.columns]
        if not original and out.content is None and not route:
            return rows, [*(F.col(c) for c in nodes.columns), kind]
        nodes = own(nodes).join(claims, "id", "left_semi")
        if out.content is not None and out.content.max:
            kept = budget(nodes, of(universe.edges_delta if original and universe.edges_delta is not None else universe.edges), out.content)
            nodes = nodes.drop("content").join(kept.where("slot = 'node'").select("id", "content"), "id").select(*nodes.columns)
        values = nodes.select("id", F.struct(*(F.col(c) for c in nodes.columns)).alias("_value"))
    wide = rows.join(values, "id")
    if route:
        hops = rows.select("id", F.posexplode("route.id").alias("_place", "_at")).join(values.select(F.col("id").alias("_at"), F.col("_value").alias("_hop")), "_at")
        by_place = lambda a, b: F.when(a.getField("_place") < b.getField("_place"), -1).otherwise(1)
        along = hops.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_hop")), by_place), lambda x: x.getField("_hop")).alias("_claims"))
        wide = wide.join(along, "id")
        ids = [*ids, F.col("_claims").alias("claims")]
    return wide, [*shown, *ids, kind]
