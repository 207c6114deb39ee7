"""Single claims, and references chosen by their type or a field."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def references(edges: DataFrame, *, type_: str | None = None, types: Iterable[str] | None = None, field: tuple[str, str] | None = None) -> DataFrame:
    """References that pass every filter given: of one type, of one of several types, with a field of a value. A reference without the field never passes."""
    out = edges
    if type_ is not None:
        out = out.where(F.col("type") == type_)
    if types is not None:
        out = out.where(F.col("type").isin(list(types)))
    if field is not None:
        out = out.where(F.try_element_at("fields", F.lit(field[0])) == field[1])
    return out


def positioned(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """ids (position, id) with `held`, whether the store has the claim, and its `height`; both in the order of the positions."""
    known = rows.select("id", F.lit(True).alias("held"), "height")
    return ids.join(known, "id", "left").withColumn("held", F.coalesce("held", F.lit(False))).orderBy("position")


def without(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """rows but those of the ids; ids that are not held change nothing."""
    return rows.join(ids.select(F.col("id").alias(key)), key, "left_anti")
