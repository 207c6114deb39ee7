"""Integrity rules: each yields the claims that break it as rows (id, rule, detail).

Most rules look at a reference and its two ends, or at a claim and a few numbers of its references. They are conditions on one wide table of references and one of claims, so any number
of them is one pass: references are joined with their ends once, and summed up by claim once. Only the columns that the rules at hand need are joined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions.ids import BASE32, CONV, address_column
from claimweave.model import EDGE_CLASSES, NODE_CLASSES, STRUCTURAL, SUBTYPE, TIME_FIELDS, Universe
from claimweave.operators.chunks import digests
from claimweave.operators.closure import closure
from claimweave.operators.kinds import rows
from claimweave.plans.predicate import nanoseconds

#: What a failure of a rule is called.
LABELS = {"monotone": "created_at", "type_classes": "type", "content_encoding": "encoding", "structure_kept": "structural", "time_fields": "time_field", "signed": "signer"}
#: Rules that need the citing claim, the claim cited, the reference before, the sums by claim, and the signer's key.
CITING, CITED, BEFORE = {"monotone", "table_reference"}, {"height", "monotone", "table_reference", "delete_by"}, {"edge_order"}
SUMMED, KEYED = {"first_table", "height", "delete_target", "key_window", "signed"}, {"key_window"}


def _field(name: str, fields: str = "fields") -> Column:
    return F.try_element_at(fields, F.lit(name))


def _unclassed(classes: tuple[str, ...]) -> Column:
    return ~F.col("type_class").isin(*classes) | ~F.col("type_sub").rlike(SUBTYPE)


def _unnamed() -> Column:
    """Content without an encoding."""
    return (F.col("content").isNotNull() | F.col("content_hash").isNotNull()) & F.col("encoding").isNull()


def _of_references() -> dict[str, tuple[Column, Column]]:
    """Rules of references: when one is broken, and the detail."""
    relation = F.col("type_class") == "relation"
    return {
        "monotone": (F.expr("s_created_at_ns < d_created_at_ns"), F.col("dst")),
        "type_classes": (_unclassed(EDGE_CLASSES), F.col("type")),
        "direction": ((relation & ~F.col("relation_direction").isin(-1, 1)) | (~relation & (F.col("relation_direction") != 0)), F.col("relation_direction").cast("string")),
        "edge_order": (F.expr("before > place"), F.col("edge_id")),
        "content_encoding": (_unnamed(), F.lit("content without encoding")),
        "table_reference": (F.expr("d_type = 'contribution/branches' and (s_type <> 'contribution/branches' or type not in ('contribution/diff', 'contribution/branches'))"), F.col("dst")),
        "delete_by": (F.col("d_id").isNotNull() & ~_field("delete_by").eqNullSafe(_field("delete_by", "d_fields")), F.col("dst")),
    }


def _of_claims() -> dict[str, tuple[Column, Column]]:
    """Rules of claims and the sums of their references. A claim has no row of sums if it references nothing."""
    least = F.coalesce(F.col("top") + 1, F.lit(0))
    at, ill = F.col("created_at_ns"), F.coalesce("bad_start", "bad_end", "bad_expiry")
    outside = (at < F.col("start")) | (at > F.least("end", "ended"))
    bad_times = [_field(f).isNotNull() & nanoseconds(_field(f)).isNull() for f in TIME_FIELDS]
    return {
        "first_table": (F.expr("type = 'contribution/branches' and others = 0 and height <> 1"), F.col("height").cast("string")),
        "height": (F.when(F.coalesce("gone", F.lit(0)) > 0, F.col("height") < least).otherwise(F.col("height") != least), F.concat_ws(" instead of ", "height", least)),
        "type_classes": (_unclassed(NODE_CLASSES), F.col("type")),
        "delete_target": (F.expr("type = 'contribution/delete' and coalesce(marks, 0) = 0"), F.lit("no reference")),
        "content_encoding": (_unnamed(), F.lit("content without encoding")),
        "key_window": ((F.col("signer") != F.col("id")) & (ill.isNotNull() | outside), F.coalesce(ill, F.col("signer"))),
        "structure_kept": (F.col("type").isin(*STRUCTURAL) & _field("delete_by").isNotNull(), F.col("type")),
        "time_fields": (bad_times[0] | bad_times[1] | bad_times[2], F.lit("not an instant")),
        "signed": (F.col("signer").isNull(), F.lit("0 contributors")),
    }


def _references(u: Universe, names: set[str], within: DataFrame | None) -> DataFrame:
    """References with what the rules need of their ends (s_ and d_; d_id is null where the claim cited is not stored) and of the reference before them."""
    links = u.edges if within is None else u.edges.join(within.select(F.col("id").alias("src")), "src", "left_semi")
    pick = lambda p, *columns: u.nodes.select(*(F.col(c).alias(f"{p}_{c}") for c in ("id", *columns)))
    if names == {"delete_by"} and u.kinds is not None:
        links = links.where(_may_be_dated(u, links))
    if names & BEFORE:
        # byte order of ids without decoding them: their alphabet as one that sorts by value; a join on (claim, place), as a claim may have any number of references
        links = links.withColumn("place", F.translate("edge_id", BASE32, CONV))
        links = links.join(links.select("src", (F.col("ord") + 1).alias("ord"), F.col("place").alias("before")), ["src", "ord"], "left")
    if names & CITING:
        links = links.join(pick("s", "created_at_ns", "type"), F.col("src") == F.col("s_id"), "left")
    if names & CITED:
        links = links.join(pick("d", "height", "created_at_ns", "type", "fields"), F.col("dst") == F.col("d_id"), "left")
    return links


def _may_be_dated(u: Universe, links: DataFrame) -> Column:
    """References that state a planned deletion, or cite types of which some claim has one: others agree with what they cite."""
    types = [r.type for r in u.nodes.where(_field("delete_by").isNotNull()).select("type").distinct().collect()]
    into = {e for _, e, d in u.kinds.links if d in types}
    return (F.col("type").isin(sorted(into)) & u.kinds.holds("dst", frozenset(types))) | _field("delete_by").isNotNull()


def _sums(links: DataFrame, names: set[str]) -> list[Column]:
    contributor = F.col("type") == "contribution/contributor"
    out = [F.count_if(~contributor).alias("others"), F.count_if(F.col("type") == "contribution/delete").alias("marks"), F.min(F.when(contributor, F.struct("ord", "dst"))).alias("first")]
    return [*out, F.max("d_height").alias("top"), F.count_if(F.col("d_id").isNull()).alias("gone")] if "height" in names else out


def _signer() -> Column:
    """The first contributor that a claim references; a claim without references signs itself."""
    return F.when(F.col("src").isNull(), F.col("id")).otherwise(F.col("first.dst"))


def signers(u: Universe, within: DataFrame | None = None) -> DataFrame:
    """(id, type, signer): null where a claim references others but no contributor."""
    nodes = u.nodes if within is None else u.nodes.join(within.select("id"), "id", "left_semi")
    by = _references(u, set(), within).groupBy("src").agg(*_sums(u.edges, set()))
    return nodes.select("id", "type").join(by, F.col("id") == F.col("src"), "left").select("id", "type", _signer().alias("signer"))


def expiries(u: Universe, roots: DataFrame | None = None) -> DataFrame:
    """(signer, ended, bad_expiry): when a contributor's key ends by the expiry references that name it: the earliest date that one of them carries. roots: only those
    in the closure of these claims (id) count. bad_expiry: a date that can't be read."""
    marks = u.edges.where("type = 'contribution/expiry'").withColumn("date", _field("pubkey_expires_after")).where("date is not null")
    if roots is not None and not marks.isEmpty():
        marks = marks.join(closure(roots, u.edges, u.max_height).withColumnRenamed("id", "src"), "src", "left_semi")
    at = nanoseconds(F.col("date"))
    return marks.groupBy(F.col("dst").alias("signer")).agg(F.min(at).alias("ended"), F.min(F.when(at.isNull(), F.concat(F.lit("pubkey_expires_after="), "date"))).alias("bad_expiry"))


def _keys(u: Universe, roots: DataFrame | None) -> DataFrame:
    """What bounds each contributor's key."""
    bound = lambda f: nanoseconds(_field(f))
    ill = lambda f: F.when(_field(f).isNotNull() & bound(f).isNull(), F.concat(F.lit(f"{f}="), _field(f)))
    own = u.nodes.select(F.col("id").alias("signer"), bound("pubkey_valid_from").alias("start"), bound("pubkey_expires_after").alias("end"), ill("pubkey_valid_from").alias("bad_start"), ill("pubkey_expires_after").alias("bad_end"))
    return own.where("start is not null or end is not null or bad_start is not null or bad_end is not null").join(expiries(u, roots), "signer", "full")


def _failures(rules: dict[str, tuple[Column, Column]], order: dict[str, int]) -> Column:
    """An array of the failures of a row, in order."""
    own = sorted((n for n in rules if n in order), key=order.get)
    each = [F.when(rules[n][0], F.struct(F.lit(order[n]).alias("_n"), F.lit(LABELS.get(n, n)).alias("rule"), rules[n][1].alias("detail"))) for n in own]
    return F.array_compact(F.array(*each))


def _passed(u: Universe, order: dict[str, int], within: DataFrame | None, first_only: bool, roots: DataFrame | None) -> DataFrame:
    """(id, f): failures of the rules named in order, all in one pass over references and claims."""
    names, refs = set(order), _of_references()
    links = _references(u, names, within)
    on_links = bool(names & refs.keys())
    if on_links:
        links = links.withColumn("failures", _failures(refs, order))
    nodes = u.nodes if within is None else u.nodes.join(within.select("id"), "id", "left_semi")
    sums = _sums(links, names) if names & SUMMED else []
    if on_links and first_only:
        sums.append(F.min(F.try_element_at("failures", F.lit(1))).alias("worst"))
    rows = nodes
    if sums:
        rows = rows.join(links.groupBy("src").agg(*sums), F.col("id") == F.col("src"), "left")
        if names & SUMMED:
            rows = rows.withColumn("signer", _signer())
    if names & KEYED:
        rows = rows.join(_keys(u, roots), "signer", "left")
    own = _failures(_of_claims(), order)
    if on_links and first_only:
        own = F.array_compact(F.concat(own, F.array("worst")))
    out = rows.select("id", F.explode(own).alias("f"))
    if on_links and not first_only:
        out = out.unionByName(links.select(F.col("src").alias("id"), F.explode("failures").alias("f")))
    return out


def _rule(name: str, doc: str) -> Callable[[Universe], DataFrame]:
    def run(u: Universe, roots: DataFrame | None = None) -> DataFrame:
        return _passed(u, {name: 0}, None, False, roots).select("id", "f.rule", "f.detail")

    run.__name__, run.__doc__ = name, doc
    return run


first_table = _rule("first_table", "A branch table whose only reference is its contributor has height 1.")
height = _rule("height", "A claim lies one above the highest that it references; at least so where one of them is gone.")
monotone = _rule("monotone", "No claim is older than one that it references.")
type_classes = _rule("type_classes", "Classes of types come from closed sets; subtypes have one form.")
direction = _rule("direction", "Relations have a direction, other references have none.")
edge_order = _rule("edge_order", "References stand in the byte order of their ids.")
delete_target = _rule("delete_target", "A delete mark names what it marks.")
content_encoding = _rule("content_encoding", "Content of a claim or a reference has an encoding.")
table_reference = _rule("table_reference", "Only a branch table references a branch table, and by its diff or branches reference.")
key_window = _rule("key_window", "Claims lie within their signer's key: from valid_from to the earlier of expires_after and the dates of expiry references. A contributor states its window and is not judged by it; a date that can't be read fails all that it bounds.")
delete_by = _rule("delete_by", "A reference states the planned deletion of what it references, or neither has one.")
structure_kept = _rule("structure_kept", "Structural claims have no planned deletion.")
time_fields = _rule("time_fields", "Fields that hold instants can be read.")
signed = _rule("signed", "A claim references a contributor, or nothing at all.")


def content_integrity(u: Universe) -> DataFrame:
    """Contents of claims and references match the address and the size that these state; external ones where the store has contents, whole or in chunks. Each stored content is hashed once, and whole ones stay where they are."""
    parts = ("content", "content_hash", "content_size")
    carriers = u.nodes.select("id", *parts).unionByName(u.edges.select(F.col("src").alias("id"), *parts)).where("content_hash is not null")
    own = carriers.where("content is not null").where((address_column(F.col("content")) != F.col("content_hash")) | (F.length("content") != F.col("content_size"))).select("id", "content_hash")
    stores = []
    if u.contents is not None:
        stores.append(u.contents.select(F.col("hash").alias("content_hash"), (address_column(F.col("bytes")) == F.col("hash")).alias("same"), F.length("bytes").cast("long").alias("n")))
    if u.chunks is not None:
        stores.append(digests(u.chunks).select(F.col("hash").alias("content_hash"), (F.col("fault").isNull() & (F.col("address") == F.col("hash"))).alias("same"), "n"))
    if stores:
        held = stores[0] if len(stores) == 1 else stores[0].unionByName(stores[1].join(stores[0], "content_hash", "left_anti"))
        outer = carriers.where("content is null").join(held, "content_hash", "left")
        own = own.unionByName(outer.where("same is null or not same or n <> content_size").select("id", "content_hash"))
    return own.select("id", F.lit("content").alias("rule"), F.col("content_hash").alias("detail"))


def archive_head(u: Universe, head: str) -> DataFrame:
    """The archive's head is a branch table that is stored."""
    own = rows(u.kinds, u.nodes, None if u.kinds is None else u.kinds.of(head)).where(F.col("id") == head)
    asked = u.nodes.sparkSession.createDataFrame([(head,)], "id string").join(own.select("id", "type"), "id", "left")
    return asked.where("type is null or type <> 'contribution/branches'").select("id", F.lit("archive_head").alias("rule"), F.coalesce("type", F.lit("not stored")).alias("detail"))


def unexplained(u: Universe, roots: DataFrame) -> DataFrame:
    """References within a closure to claims that are not stored, unless the reference is dated for deletion or a mark names the claim."""
    inside = closure(roots, u.edges).withColumnRenamed("id", "src")
    marked = u.edges.where("type = 'contribution/delete'").select("dst").distinct()
    gaps = u.edges.join(inside, "src", "left_semi").where(_field("delete_by").isNull()).join(u.nodes.select(F.col("id").alias("dst")), "dst", "left_anti").join(marked, "dst", "left_anti")
    return gaps.select(F.col("src").alias("id"), F.lit("gap").alias("rule"), F.col("dst").alias("detail"))


def raw_ids(u: Universe) -> DataFrame:
    """Ids are the addresses of the stored envelopes."""
    rows = u.raw.withColumn("address", address_column(F.col("envelope"))).where("id <> address")
    return rows.select("id", F.lit("id").alias("rule"), F.col("address").alias("detail"))


def signatures(u: Universe) -> DataFrame:
    """Stored envelopes are signed with the key that the signer's content holds."""
    from claimweave.functions.signatures import faults

    keys = u.nodes.select(F.col("id").alias("signer"), F.col("content").alias("key"), F.col("content_hash").alias("hash")).where("key is not null or hash is not null")
    if u.contents is not None:
        keys = keys.join(u.contents.select("hash", "bytes"), "hash", "left").select("signer", F.coalesce("key", "bytes").alias("key"))
    rows = u.raw.join(signers(u).select("id", "signer"), "id").join(keys.select("signer", "key"), "signer", "left").select("id", "envelope", "key")
    return faults(rows, "envelope", "key").where("fault is not null").select("id", F.lit("signature").alias("rule"), F.col("fault").alias("detail"))


#: The order in which rules are tried: of a claim's failures the first is reported.
RULES: tuple[Callable[[Universe], DataFrame], ...] = (first_table, height, monotone, type_classes, direction, edge_order, delete_target, content_encoding, table_reference, key_window, delete_by, structure_kept, time_fields, signed)
_TOGETHER = {r.__name__ for r in RULES}


def violations(u: Universe, skip: tuple[str, ...] = (), within: DataFrame | None = None, first_only: bool = True, rules: tuple[Callable[[Universe], DataFrame], ...] = RULES, roots: DataFrame | None = None) -> DataFrame:
    """Claims that break a rule (id, rule, detail), each with its first failure. within: ids to which the check is confined, before anything is looked at.
    roots: the claims in whose closure expiries count; by default all do."""
    order = {r.__name__: n for n, r in enumerate(rules) if r.__name__ not in skip}
    together = {n: k for n, k in order.items() if n in _TOGETHER}
    parts = [_passed(u, together, within, first_only, roots)] if together else []
    inside = u
    if within is not None and len(order) > len(together):
        keep = lambda rows, column: rows.join(within.select(F.col("id").alias(column)), column, "left_semi")
        inside = u.with_(raw=None if u.raw is None else keep(u.raw, "id"))
    for r in rules:
        if r.__name__ in order and r.__name__ not in together:
            own = r(inside).select("id", F.struct(F.lit(order[r.__name__]).alias("_n"), "rule", "detail").alias("f"))
            parts.append(own if within is None else own.join(within.select("id"), "id", "left_semi"))
    if not parts:
        return u.nodes.where(F.lit(False)).select("id", F.lit("").alias("rule"), F.lit("").alias("detail"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    if first_only:
        every = every.groupBy("id").agg(F.min("f").alias("f"))
    return every.select("id", "f.rule", "f.detail")
