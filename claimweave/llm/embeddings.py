"""Embedding near-duplicates: quantised tile products with error bounds inside random-hyperplane buckets.

1. Vectors of equal components are one class, a node. A class is scaled to unit length and quantised to 8 bits, and gets a key in each of a number of tables, the
   signs of random projections. The key's length follows the number of classes, and the number of tables follows from it, so that a pair at the
   threshold misses all tables with a probability of MISS at most.
2. A bucket is cut into blocks, and each pair of blocks is a tile: one task sees two blocks at most, whatever the bucket's size. Only codes travel.
3. The product of two quantised vectors lies within e(1 + e') + e' of the cosine, e and e' being the vectors' own quantisation errors. A tile counts the
   pairs that surely reach the threshold, and marks vectors of pairs whose interval holds it. Marked vectors meet once more in the same tile, in double
   precision, and only those pairs are computed. A pair counts in the first table only in which it meets.
4. A tile returns a count for each vector and its smallest connected node, never its pairs.

Vectors that are null, zero, or hold null or non-finite components link with nothing; vectors of different lengths do not meet. Rows that repeat an id are vectors of
their own, and an id never joins groups; a component's label is its least id that is not null. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import components, key64, runs, stored

#: The chance that a pair exactly at the threshold shares no bucket.
MISS = 1e-4
#: Vectors of a block, and about as many unrelated ones of a bucket.
BLOCK = 1024
LEAST_BITS, MOST_BITS = 4, 24
#: What stands before a vector's codes: a component is its code times the scale, up to the error's norm.
HEAD = np.dtype([("node", "<i8"), ("n", "<i8"), ("scale", "<f4"), ("error", "<f4")])


def tables(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """Bits of a key and number of tables for n vectors."""
    bits = min(MOST_BITS, max(LEAST_BITS, round(math.log2(max(n, 1) / BLOCK))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - same))


def hyperplanes(dimension: int, bits: int, n_tables: int) -> np.ndarray:
    return np.random.default_rng(key64("hyperplanes", dimension)).standard_normal((dimension, bits * n_tables))


def usable(values) -> np.ndarray | None:
    """A vector of finite components that are not all zero, else None."""
    if values is None or not len(values) or any(x is None for x in values):
        return None
    x = np.asarray(values, np.float64)
    return x if np.isfinite(x).all() and x.any() else None


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of unit length; first divided by their largest component, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def digests(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, digest, vector): the components as doubles; both null for a vector that links with nothing."""
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("embedding"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [usable(x) for x in batch.column(1).to_pylist()]
            raw = [None if x is None else (x + 0.0).tobytes() for x in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x and hashlib.blake2b(x, digest_size=16).digest() for x in raw], pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "digest", "vector"])

    return rows.mapInArrow(digest, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, digest binary, vector binary")


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit codes of unit vectors, with each vector's scale and a bound of its error's norm."""
    scale = np.float32(np.abs(x).max(axis=1) / 127 * (1 + 1e-6))
    code = np.rint(x / scale[:, None].astype(np.float64)).astype(np.int8)
    error = np.sqrt(((x - code * scale[:, None].astype(np.float64)) ** 2).sum(axis=1)) + 1e-8
    return code, scale, np.nextafter(np.float32(error), np.float32(np.inf))


def width(bits: int) -> str:
    """The type of a key."""
    return "<u2" if bits <= 16 else "<u4"


def coded(classes: DataFrame, bits: int, n_tables: int) -> DataFrame:
    """(code, keys, size): HEAD and codes of each class, its key in each table, and its number of components."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        power = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            codes, keys, sizes = [], [], []
            for node, n, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                x = unit(np.frombuffer(raw)[None, :])
                d = x.shape[1]
                if d not in planes:
                    planes[d] = hyperplanes(d, bits, n_tables)
                signs = (x @ planes[d])[0].reshape(n_tables, bits) > 0
                own, scale, error = quantised(x)
                codes.append(np.array([(node, n, scale[0], error[0])], HEAD).tobytes() + own.tobytes())
                keys.append((signs @ power).astype(width(bits)).tobytes())
                sizes.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.binary()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64())], names=["code", "keys", "size"])

    return classes.select("node", "n", "vector").mapInArrow(code, "code binary, keys binary, size long")


def buckets(codes: DataFrame, bits: int, payload: bool) -> DataFrame:
    """(at), or (at, nth, code): the bucket of each class in each table, and its code followed by its keys in the tables before."""
    kind = np.dtype(width(bits))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                code, raw, size = (part.column(k).to_pylist() for k in range(3))
                keys = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.int64)
                nth = np.arange(keys.shape[1], dtype=np.int64)
                place = ((nth[None, :] << 24 | keys) * 65536 + np.array(size)[:, None]).ravel()
                if not payload:
                    yield pa.RecordBatch.from_arrays([pa.array(place)], names=["at"])
                    continue
                out = [c + k[: t * kind.itemsize] for c, k in zip(code, raw, strict=True) for t in range(len(nth))]
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.tile(nth, len(raw))), pa.array(out, pa.binary())], names=["at", "nth", "code"])

    return codes.select("code", "keys", "size").mapInArrow(explode, "at long, nth long, code binary" if payload else "at long")


class Tile:
    """The rows of a tile: heads, codes, keys in earlier tables, and which rows are on which side."""

    def __init__(self, code: list[bytes], block: np.ndarray, nth: int, kind: str):
        raw = np.frombuffer(b"".join(code), np.uint8).reshape(len(code), -1)
        ends = raw.shape[1] - nth * np.dtype(kind).itemsize
        self.head = np.frombuffer(np.ascontiguousarray(raw[:, : HEAD.itemsize]).tobytes(), HEAD)
        self.code = np.ascontiguousarray(raw[:, HEAD.itemsize : ends]).view(np.int8)
        self.keys = np.ascontiguousarray(raw[:, ends:]).view(kind)
        first = block == block.min()
        self.left, self.right = np.flatnonzero(first), np.flatnonzero(~first)
        self.one = not len(self.right)
        if self.one:
            self.right = self.left

    def pairs(self, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, sure) of pairs that may reach the threshold and meet in no earlier table. sure: whatever the errors are."""
        d = self.code.shape[1]
        exact = np.float32 if d * 127 * 127 < 1 << 24 else np.float64  # sums of products stay whole numbers
        scale, error = self.head["scale"].astype(np.float64), self.head["error"].astype(np.float64)
        right = self.code[self.right].astype(exact).T
        for at in range(0, len(self.left), 256):
            left = self.left[at : at + 256]
            product = (self.code[left].astype(exact) @ right).astype(np.float64) * scale[left][:, None] * scale[self.right][None, :]
            bound = error[left][:, None] * (1 + error[self.right][None, :]) + error[self.right][None, :]
            a, b = np.nonzero(product + bound >= threshold)
            sure = product[a, b] - bound[a, b] >= threshold
            i, j = left[a], self.right[b]
            new = ~(self.keys[i] == self.keys[j]).any(axis=1) if self.keys.shape[1] else np.ones(len(i), bool)
            if self.one:
                new &= i < j
            yield i[new], j[new], sure[new]

    def summed(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the summed weights of its partners and the smallest node connected with it."""
        node, weight = self.head["node"], self.head["n"]
        count, root = np.zeros(len(node), np.int64), node.copy()
        np.add.at(count, i, weight[j])
        np.add.at(count, j, weight[i])
        while True:
            low = np.minimum(root[i], root[j])
            was = root.copy()
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
            if (was == root).all():
                return count, root


def _joined(parts: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def links(codes: DataFrame, vectors: DataFrame, bits: int, threshold: float) -> DataFrame:
    """(node, n, root): partial counts of links and nodes connected with node, from each tile in which node has a link. vectors: node, vector."""
    # a table of the few buckets that need cutting; its size is known when the join is planned, which decides how it travels
    large = stored(buckets(codes, bits, False).groupBy("at").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > BLOCK).select("at", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    rows = buckets(codes, bits, True).join(large, "at", "left").withColumn("block", F.pmod(F.xxhash64("code"), F.coalesce("blocks", F.lit(1))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    rows = rows.select(F.xxhash64("at", F.least("block", "other"), F.greatest("block", "other")).alias("tile"), (F.shiftleft("nth", 40) + F.col("block")).alias("place"), "code")
    kind = width(bits)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "tile"):
            if len(group) < 2:
                continue
            place, code = group["place"].to_numpy(), group["code"].to_pylist()
            tile = Tile(code, place & ((1 << 40) - 1), int(place[0] >> 40), kind)
            i, j, sure = _joined(list(tile.pairs(threshold)))
            count, root = tile.summed(i[sure], j[sure])
            doubt = np.zeros(len(code), bool)
            doubt[i[~sure]] = doubt[j[~sure]] = True
            if len(some := np.flatnonzero((count > 0) | doubt)):
                marked = [code[k] if doubt[k] else None for k in some.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(tile.head["node"][some]), pa.array(count[some]), pa.array(root[some]), group["tile"].take(pa.array(some)).combine_chunks(), pa.array(place[some]), pa.array(marked, pa.binary())], names=["node", "n", "root", "tile", "place", "code"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "tile"):
            place = group["place"].to_numpy()
            tile = Tile(group["code"].to_pylist(), place & ((1 << 40) - 1), int(place[0] >> 40), kind)
            x = unit(np.frombuffer(b"".join(group["vector"].to_pylist())).reshape(len(group), -1))
            i, j, sure = _joined(list(tile.pairs(threshold)))
            i, j = i[~sure], j[~sure]
            true = np.concatenate([np.zeros(0, bool), *(np.einsum("ij,ij->i", x[i[k : k + 4096]], x[j[k : k + 4096]]) >= threshold for k in range(0, len(i), 4096))])
            count, root = tile.summed(i[true], j[true])
            if (some := count > 0).any():
                yield pa.RecordBatch.from_arrays([pa.array(tile.head["node"][some]), pa.array(count[some]), pa.array(root[some])], names=["node", "n", "root"])

    found = stored(rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(compare, "node long, n long, root long, tile long, place long, code binary"))
    doubts = found.where("code is not null").select("node", "tile", "place", "code").join(vectors, "node").drop("node")
    more = doubts.repartition("tile").sortWithinPartitions("tile").mapInArrow(again, "node long, n long, root long")
    return found.where("n > 0").select("node", "n", "root").unionByName(more)


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding", miss: float = MISS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row."""
    base = stored(digests(vectors, vec_id, embedding))
    some = base.where("digest is not null")
    classes = some.groupBy("digest").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.min("vector").alias("vector"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()))
    bits, n_tables = tables(classes.count(), threshold, miss)
    found = stored(links(stored(coded(classes, bits, n_tables)), classes.select("node", "vector"), bits, threshold))
    counts = found.groupBy("node").agg(F.sum("n").alias("links"))
    joined = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    of = classes.select("digest", "node", "least", (F.col("n") - 1).alias("copies")).join(counts, "node", "left").join(joined, "node", "left")
    of = stored(of.select("digest", "least", (F.col("copies") + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component")))
    labels = of.groupBy("component").agg(F.min("least").alias("component_id"))
    out = some.select("vec_id", "digest").join(of.join(labels, "component"), "digest").select("vec_id", "n_links", "component_id")
    none = base.where("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(none).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all rows of embeddings at a cosine of 0.95 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
