"""What a claim has to keep when it is made, as rows of (id, rule, detail): fields, contents and their encodings, and references that stand once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions.wire import MEDIA
from claimweave.model import INLINE_CAP, SUBTYPE, Universe
from claimweave.operators import verify

# Bytes of a field's name and value, and fields of a record.
NAME_BYTES, VALUE_BYTES, MOST_FIELDS = 128, 64 * 1024, 256
MEDIA_TYPE = r"\A(" + "|".join(MEDIA) + r")/[A-Za-z0-9][A-Za-z0-9_.+-]*\z"
SINGLE = ("contribution/contributor", "contribution/diff")


def _record_rules() -> dict[str, Column]:
    """The rules that a node and a reference share, each as the condition that breaks it."""
    names, values = F.map_keys("fields"), F.map_values("fields")
    holds = F.col("content").isNotNull() | F.col("content_hash").isNotNull()
    return {
        "field_count": F.size("fields") > MOST_FIELDS,
        "field_name": F.exists(names, lambda x: (F.octet_length(x) > NAME_BYTES) | ~x.rlike(SUBTYPE)),
        "field_value": F.exists(values, lambda x: F.octet_length(x) > VALUE_BYTES),
        "content_twice": F.col("content").isNotNull() & F.col("content_hash").isNotNull(),
        "content_inline": F.octet_length("content") > INLINE_CAP,
        "encoding_missing": holds & F.col("encoding").isNull(),
        "encoding_alone": ~holds & F.col("encoding").isNotNull(),
        "encoding_form": ~F.col("encoding").rlike(MEDIA_TYPE),
    }


def _records(rows: DataFrame, id_: str, detail: str) -> DataFrame:
    """One pass over the rows, whatever the number of rules."""
    broken = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in _record_rules().items())))
    return rows.select(F.col(id_).alias("id"), F.explode(broken).alias("rule"), F.col(detail).alias("detail"))


def single(edges: DataFrame) -> DataFrame:
    """A claim has one contributor and lies over one claim, at most."""
    many = edges.where(F.col("type").isin(*SINGLE)).groupBy("src", "type").count().where("count > 1")
    return many.select(F.col("src").alias("id"), F.lit("single").alias("rule"), F.col("type").alias("detail"))


def named(edges: DataFrame) -> DataFrame:
    """A claim that lies over another names its other references, each name once: the overlay goes by names."""
    over = edges.where("type = 'contribution/diff'").select("src").distinct()
    name = F.coalesce(F.try_element_at("fields", F.lit("name")), F.lit(""))
    # counted by claim and name: a claim may have any number of references
    each = edges.where(~F.col("type").isin(*SINGLE)).join(over, "src", "left_semi").groupBy("src", name.alias("name")).count().where("name = '' or count > 1")
    return each.select(F.col("src").alias("id"), F.lit("edge_name").alias("rule"), F.col("name").alias("detail"))


def refused(u: Universe) -> DataFrame:
    """All that is wrong with new claims, and with their references under the claim's id. u: their nodes and references as they were written."""
    nodes = u.nodes if u.nodes_delta is None else u.nodes_delta
    edges = u.edges if u.edges_delta is None else u.edges_delta
    written = u.with_(nodes=nodes, edges=edges)
    parts = [_records(nodes, "id", "type"), _records(edges, "src", "type"), single(edges), named(edges), verify.type_classes(written), verify.direction(written)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every
