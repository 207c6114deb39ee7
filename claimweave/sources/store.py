"""Claim tables in a folder: Parquet, hash-partitioned by id where that is asked for, and CBOR sequences of records."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import fields

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions import cbor
from claimweave.model import SCHEMAS, Universe


def save(universe: Universe, path: str, shards: int | None = None) -> None:
    """Write every table that the universe has. shards: nodes and references by hash of the claim, so that their joins find like with like."""
    for f in fields(universe):
        rows = getattr(universe, f.name)
        if isinstance(rows, DataFrame) and f.name != "reverse":
            key = {"nodes": "id", "edges": "src"}.get(f.name)
            (rows.repartition(shards, key) if shards and key else rows).write.mode("overwrite").parquet(f"{path}/{f.name}")


def load(spark: SparkSession, path: str, *tables: str) -> Universe:
    """The tables named, by default nodes and edges; schemas are fixed, never inferred."""
    read = lambda t: spark.read.schema(SCHEMAS[t.removesuffix("_delta")]).parquet(f"{path}/{t}")
    return Universe(**{t: read(t) for t in {"nodes", "edges", *tables}})


def _named(path: str, table: str) -> str:
    return f"claims_{hashlib.sha256(path.encode()).hexdigest()[:16]}_{table}"


#: Bucketed copies: the table they are made of, and the column they are bucketed and sorted by. References lie there twice, once for each direction of a hop.
BUCKETED = {"nodes": ("nodes", "id"), "edges": ("edges", "src"), "reverse": ("edges", "dst")}


def save_bucketed(universe: Universe, path: str, buckets: int) -> Universe:
    """Write nodes and references in buckets that the planner knows: hops and look-ups shuffle what they look for, not the tables. Returns them as open_bucketed() does."""
    spark = universe.nodes.sparkSession
    for table, (of, key) in BUCKETED.items():
        name = _named(path, table)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        rows = getattr(universe, of).select(*(c.split()[0] for c in SCHEMAS[of].split(", ")))
        # one task for each bucket, so that each is one file in order
        rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", f"{path}/{table}").mode("overwrite").saveAsTable(name)
    return open_bucketed(spark, path, buckets)


def open_bucketed(spark: SparkSession, path: str, buckets: int) -> Universe:
    """The tables of save_bucketed(), registered in this session's catalog where they are not yet."""
    for table, (of, key) in BUCKETED.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {_named(path, table)} ({SCHEMAS[of]}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}/{table}'")
    return Universe(**{t: spark.table(_named(path, t)) for t in BUCKETED})


def layered(*tiers: DataFrame, key: str = "id") -> DataFrame:
    """Rows of several stores; of a key that more than one holds, the row of the first."""
    out = tiers[0]
    for tier in tiers[1:]:
        out = out.unionByName(tier.join(out.select(key), key, "left_anti"))
    return out


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """(hash, bytes) of a folder with one file for each content, named by its hash."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("hash"), F.col("content").alias("bytes"))


def cbor_records(files: DataFrame) -> DataFrame:
    """(path, position, record): the items of CBOR sequences, encoded one by one; files: path, content."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                items, at = [], 0
                while at < len(content):
                    _, end = cbor.read(content, at)
                    items.append(content[at:end])
                    at = end
                yield pa.RecordBatch.from_pydict({"path": pa.array([path] * len(items), pa.string()), "position": pa.array(range(len(items)), pa.int64()), "record": pa.array(items, pa.binary())})

    return files.select("path", "content").mapInArrow(split, "path string, position long, record binary")
