"""Shared helpers: whole-row streams over sorted partitions, connected components."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.storage import reliable, stored

__all__ = ["SPACES", "components", "documents", "key64", "pieces", "reliable", "rounds_until_stable", "runs", "stored", "unit_hash"]

#: White space that parts words, as the word contracts state it: 0x20 and 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"
BREAK = re.compile(f"[{SPACES}]")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table, or only the columns named."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def key64(*parts: object) -> int:
    """A 64-bit number that depends on the parts only."""
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little")


def pieces(text: str, size: int = 1 << 20) -> Iterator[str]:
    """A text in pieces of `size` characters or little more, each but the last one up to white space, so that no word is cut; a run without any white space is one piece."""
    at = 0
    while len(text) - at > size:
        found = BREAK.search(text, at + size)
        if found is None:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:] if at else text


def unit_hash(*columns: Column) -> Column:
    """A reproducible number in [0, 1) from the columns' values."""
    return (F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double")) / F.lit(float(1 << 53))


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of equal key, from batches sorted by it; nulls are one key. A run may go over any number of batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(key))
        keys = (column.dictionary_encode(null_encoding="encode").indices if column.null_count else column).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        at = 0
        for cut in [*cuts.tolist(), batch.num_rows]:
            now = column[at].as_py()
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, cut - at))
            last, at = now, cut
    if held:
        yield pa.Table.from_batches(held)


def rounds_until_stable(step: Callable[[DataFrame], DataFrame], start: DataFrame, most: int = 60) -> DataFrame:
    """Apply step with a checkpoint after each round until the rows (two longs, u and v) stay the same."""
    digest = [F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    now, was = start, None
    for _ in range(most):
        mark = tuple(now.agg(*digest).first())
        if mark == was or not mark[0]:
            return now
        was, now = mark, reliable(step(now))
    raise RuntimeError(f"components did not settle in {most} rounds")


def components(links: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    links: longs u and v, in any order, repeated or not; loops are ignored.
    Returns (node, component) for every node that has a link to another one; component is the smallest node
    that links reach. Each round is an aggregate with map-side combine and an equi-join whose
    large keys adaptive execution splits; links never go to the driver.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            pairs = edges  # u > v holds: a node's smaller neighbours
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = pairs.join(least, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            return out.where("u <> v").distinct()
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    start = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    flat = rounds_until_stable(lambda e: star(star(e, True), False), reliable(start))
    return flat.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(flat.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
