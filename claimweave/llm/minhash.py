"""Near-duplicates by b-bit MinHash over word shingles.

1. Each text gives its set of shingle hashes, the set's digest, HASHES minima of which B_BITS low bits are kept as bit planes, and
   a key for each band of minima. Texts of equal sets fall into one class by an aggregate, so copies never meet as pairs.
2. Classes that share a band's key are candidates. In every bucket all members meet one pivot, another one in each band: as many
   pairs as members. The planes' bit counts, corrected for chance agreement, drop pairs that are surely too far apart.
3. Pairs left are confirmed on the full sets, and links become components.
4. A bucket whose members lie in more than one component is looked at again: members of its largest component and the others are cut into
   blocks, and pairs of blocks, but never two of the largest component, meet in tiles of bounded size. First signatures alone meet there, and a
   tile names the members that stand in a pair across components whose estimate may reach the threshold. Then the full sets of these come to the
   tile and confirm such pairs, once, in the first band that the two share; it returns only links that join components. So a link that
   the pivots missed is found, and no pair that is not one leaves the tile.

Null and empty texts have an empty set and link with nothing. A text of fewer words than a shingle is one shingle. Rows that repeat a
doc_id lie in one component: where their texts differ, rows are the nodes of the graph, and components that share an id are one. A row without a doc_id takes the component of
the rows that have its set (where rows are nodes, of those it links with) and an id; where none has one, it has no component. deduplicated() gives each row a key of its own, so
there rows without an id and different texts of one id are nodes too. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from claimweave.llm.common import components, documents, key64, runs, stored

SHINGLE = 5
HASHES, BANDS, ROWS, B_BITS = 128, 25, 5, 4
#: Standard errors by which an estimate may lie below the threshold.
MARGIN = 4.5
#: Members of a bucket in a block: a tile holds two blocks at most.
BLOCK = 512
#: Bytes of full sets in a part of a tile, unless one set alone has more; and ids that are broadcast to pick texts, more are joined by a shuffle.
TILE_BYTES, FEW_IDS = 64 << 20, 2_000_000

MULTIPLIERS = np.array([key64("multiplier", k) | 1 for k in range(HASHES)], np.uint64)
ADDENDS = np.array([key64("addend", k) for k in range(HASHES)], np.uint64)
BAND_SEEDS = np.array([key64("band", k) for k in range(BANDS)], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles: A-Z lower-cased, words parted by ASCII white space."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(w) - SHINGLE + 1
    h = w[:n].copy()
    for k in range(1, SHINGLE):
        h = h * np.uint64(0xBF58476D1CE4E5B9) + w[k : k + n]
    return np.unique(mixed(h))


def minima(s: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 256):
        np.minimum(out, (s[at : at + 256, None] * MULTIPLIERS + ADDENDS).min(axis=0), out=out)
    return out


def planes(low: np.ndarray) -> np.ndarray:
    """B_BITS bit planes of HASHES numbers, as 64-bit words: first all words of plane 0, and so on."""
    bits = ((mixed(low)[None, :] >> np.arange(B_BITS, dtype=np.uint64)[:, None]) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low[: BANDS * ROWS].reshape(BANDS, ROWS)
    h = BAND_SEEDS.copy()
    for k in range(ROWS):
        h = mixed(h ^ rows[:, k])
    return h


def _text(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, digest, sig, bands) for each row; the last three are null for an empty set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, digest, sig, bands = [], [], [], []
                for x in part.column(1).cast(pa.binary()).to_pylist():
                    s = shingles(x)
                    n.append(len(s))
                    if not len(s):
                        digest.append(None), sig.append(None), bands.append(None)
                        continue
                    low = minima(s)
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    sig.append(planes(low).view(np.int64))
                    bands.append(band_keys(low).view(np.int64))
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, longs), pa.array(bands, longs)], names=["doc_id", "n_shingles", "digest", "sig", "bands"])

    return _text(docs, doc_id, text).mapInArrow(sign, "doc_id long, n_shingles long, digest binary, sig array<long>, bands array<long>")


def sets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, members): the full set of each row with a word."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own = [shingles(x).view(np.int64) for x in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.list_(pa.int64()))], names=["node", "members"])

    return _text(docs, doc_id, text).mapInArrow(gather, "node long, members array<long>")


def agreement(a: str, b: str) -> Column:
    """The estimated similarity from the share of minima whose low bits agree, corrected for chance: (share - C) / (1 - C), C = 2^-b."""
    words, chance = HASHES // 64, 2.0**-B_BITS
    differing = [F.reduce(F.array(*(F.get(a, p * words + w).bitwiseXOR(F.get(b, p * words + w)) for p in range(B_BITS))), F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y)) for w in range(words)]
    share = 1.0 - sum((F.bit_count(x) for x in differing), F.lit(0)) / float(HASHES)
    return (share - chance) / (1 - chance)


def least_estimate(threshold: float) -> float:
    chance = 2.0**-B_BITS
    share = chance + (1 - chance) * threshold
    return threshold - MARGIN * math.sqrt(share * (1 - share) / HASHES) / (1 - chance)


def _picked(docs: DataFrame, ids: DataFrame, doc_id: str) -> DataFrame:
    """The rows of docs whose id stands in ids (_node). Texts stay where they are unless there are too many ids to broadcast."""
    ids = stored(ids.distinct())
    return docs.join(ids.hint("broadcast" if ids.count() <= FEW_IDS else "shuffle_hash"), F.col(f"`{doc_id}`").cast("long") == F.col("_node"), "left_semi")


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int, doc_id: str, text: str) -> DataFrame:
    """The pairs (u, v) whose full sets have 100 * intersection >= percent * union. Only texts that stand in a pair are cut to shingles."""
    wanted = _picked(docs, pairs.select(F.explode(F.array("u", "v")).alias("_node")), doc_id)
    full = stored(sets(wanted, doc_id, text).dropDuplicates(["node", "members"]).withColumn("n", F.size("members")))
    one = pairs.join(full.select(F.col("node").alias("u"), F.col("members").alias("a"), F.col("n").alias("na")), "u")
    # a pair's sizes bound its similarity, before the other set is fetched
    near = one.join(full.select(F.col("node").alias("v"), F.col("n").alias("nb")), "v").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).drop("nb")
    both = near.join(full.select(F.col("node").alias("v"), F.col("members").alias("b"), F.col("n").alias("nb")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    return both.where(100 * shared >= percent * (F.col("na") + F.col("nb") - shared)).select("u", "v").distinct()


def tiles(members: DataFrame) -> DataFrame:
    """(tile, side, band, node) for the buckets that hold more than one component.

    members: key, band, node, component. Blocks of the largest component meet blocks of the other members; these meet one another.
    """
    sizes = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    per = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    per = per.select("key", F.col("m.component").alias("largest"), blocks(F.col("m.n")).alias("nm"), blocks(F.col("all") - F.col("m.n")).alias("no"))
    rows = members.join(per, "key").withColumn("large", F.col("component") == F.col("largest")).withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("large"), F.col("nm")).otherwise(F.col("no"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    place = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    own = F.col("own")
    mixed_ = F.when(F.col("large"), F.transform(upto(F.col("no")), lambda j: place(0, own, j, F.lit(0)))).otherwise(
        F.concat(F.transform(upto(F.col("nm")), lambda i: place(0, i, own, F.lit(1))), F.transform(upto(F.col("no")), lambda k: place(1, F.least(own, k), F.greatest(own, k), F.when(own <= k, 0).otherwise(1))))
    )
    return rows.withColumn("p", F.explode(mixed_)).select(F.xxhash64("key", "p.kind", "p.i", "p.j").alias("tile"), "p.side", "band", "node")


def _first_of_equals(members: DataFrame) -> DataFrame:
    """members without the buckets whose members are those of an earlier band's bucket: near copies share many bands, and one bucket shows all their pairs."""
    mark = members.groupBy("key").agg(F.min("band").alias("band"), F.count(F.lit(1)).alias("n"), *(F.sum(F.xxhash64("node", F.lit(k)).cast("decimal(38,0)")).alias(f"h{k}") for k in (0, 1)))
    first = mark.groupBy("n", "h0", "h1").agg(F.min(F.struct("band", "key")).alias("m")).select("m.key")
    return members.join(first, "key", "left_semi")


def _candidates(group: pa.Table, least: float, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (u, v) of a tile, the likeliest first in each block, that lie in two components, may reach the threshold and share no earlier band."""
    words, chance = HASHES // 64, 2.0**-B_BITS
    component, side, band, size = (group[c].to_numpy() for c in ("component", "side", "band", "n"))
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if side.any() else left
    sig = np.array(group["sig"].to_pylist(), np.int64).view(np.uint64).reshape(len(side), B_BITS, words)
    earlier = np.array(group["bands"].to_pylist(), np.int64).reshape(len(side), BANDS)[:, : band[0]]
    for k in range(0, len(left), 64):
        i = left[k : k + 64]
        apart = np.zeros((len(i), len(right)), np.int32)
        for w in range(words):
            x = np.zeros(apart.shape, np.uint64)
            for p in range(B_BITS):
                x |= sig[i, None, p, w] ^ sig[None, right, p, w]
            apart += np.bitwise_count(x)
        value = (1 - apart / HASHES - chance) / (1 - chance)
        value[component[i, None] == component[None, right]] = -1
        value[100 * np.minimum(size[i, None], size[None, right]) < percent * np.maximum(size[i, None], size[None, right])] = -1
        a, b = np.nonzero(value >= least)
        order = np.argsort(-value[a, b], kind="stable")
        u, v = i[a[order]], right[b[order]]
        apart_before = np.ones(len(u), bool)
        for at in range(0, len(u), 4096):
            apart_before[at : at + 4096] = ~(earlier[u[at : at + 4096]] == earlier[v[at : at + 4096]]).any(axis=1)
        yield u[apart_before], v[apart_before]


def suspects(members: DataFrame, payload: DataFrame, least: float, percent: int) -> DataFrame:
    """(tile, side, band, node): the rows of tiles that stand in a candidate pair, in parts whose full sets have TILE_BYTES. payload: node, component, sig, bands, n (the set's size); no set travels."""

    def chunks(rows: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        part = (np.cumsum(8 * size[rows]) - 8 * size[rows]) // (TILE_BYTES // 2)
        return np.split(rows, np.flatnonzero(part[1:] != part[:-1]) + 1)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "tile"):
            held = np.zeros(group.num_rows, bool)
            for u, v in _candidates(group, least, percent):
                held[u] = held[v] = True
            if not held.any():
                continue
            tile, side, size, rows = group["tile"][0].as_py(), group["side"].to_numpy(), group["n"].to_numpy(), np.flatnonzero(held)
            left = chunks(rows[side[rows] == 0], size)
            right = chunks(rows[side[rows] == 1], size) if side[rows].any() else None
            for i, a in enumerate(left):
                for j, b in enumerate(left[i:] if right is None else right):
                    alone = right is None and j == 0
                    own = a if alone else np.concatenate([a, b])
                    sides = np.repeat([0, 1], [len(a), len(own) - len(a)])
                    name = tile if i == j == 0 else np.uint64(key64("part", tile, i, j)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), name, np.int64)), pa.array(sides, pa.int32()), *(group[c].take(pa.array(own)).combine_chunks() for c in ("band", "node"))], names=["tile", "side", "band", "node"])

    return tiles(_first_of_equals(members)).join(payload, "node").repartition("tile").sortWithinPartitions("tile").mapInArrow(look, "tile long, side int, band int, node long")


def across(rows: DataFrame, payload: DataFrame, least: float, percent: int) -> DataFrame:
    """Links (u, v) that join components within a tile. rows: suspects; payload: node, component, sig, bands, n, members (the full set)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "tile"):
            node, component = group["node"].to_numpy(), group["component"].to_numpy()
            own = group["members"].combine_chunks()
            at = own.offsets.to_numpy()
            flat = own.values.to_numpy().view(np.uint64)
            full = [flat[at[k] : at[k + 1]] for k in range(len(node))]
            size = np.diff(at)
            parent = {c: c for c in component.tolist()}

            def root(c: int) -> int:
                while parent[c] != c:
                    parent[c] = c = parent[parent[c]]
                return c

            found = []
            for us, vs in _candidates(group, least, percent):
                for u, v in zip(us.tolist(), vs.tolist(), strict=True):
                    ru, rv = root(int(component[u])), root(int(component[v]))
                    if ru == rv:
                        continue
                    place = np.minimum(np.searchsorted(full[u], full[v]), size[u] - 1)
                    both = int((full[u][place] == full[v]).sum())
                    if 100 * both >= percent * (size[u] + size[v] - both):
                        parent[ru] = rv
                        found.append((node[u], node[v]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["u", "v"])

    return rows.join(payload, "node").repartition("tile").sortWithinPartitions("tile").mapInArrow(compare, "u long, v long")


def _by_rows(docs: DataFrame, percent: int, doc_id: str, text: str) -> DataFrame:
    """near_duplicates() with rows as nodes; components that share an id are one."""
    rows = _numbered(docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")))
    found = near_duplicates(rows, percent, "row").select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("c"))
    found = stored(found.join(rows.select("row", F.col("doc.id").alias("doc_id")), "row"))
    spread = found.where("doc_id is not null").groupBy("doc_id").agg(F.min("c").alias("v"), F.max("c").alias("most")).where("v <> most").select("doc_id", "v")
    links = found.join(spread, "doc_id").select(F.col("c").alias("u"), "v").where("u <> v").distinct()
    groups = components(links).select(F.col("node").alias("c"), "component")
    found = stored(found.join(groups, "c", "left").withColumn("c", F.coalesce("component", "c")))
    labels = found.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    return found.join(labels, "c").select("doc_id", "n_shingles", "component_id").withColumn("kept", F.col("doc_id") == F.col("component_id"))


def near_duplicates(docs: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row; links have 100 * intersection >= percent * union. Ids may have any type that can be compared."""
    if not isinstance(docs.schema[doc_id].dataType, IntegralType):
        return _by_rows(docs, percent, doc_id, text)
    base = stored(signatures(docs, doc_id, text))
    if not base.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("digest", F.lit(b""))).alias("a"), F.max(F.coalesce("digest", F.lit(b""))).alias("b")).where("a <> b").isEmpty():
        return _by_rows(docs, percent, doc_id, text)
    classes = stored(base.where("digest is not null").groupBy("digest").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "sig", "bands", F.col("n_shingles").alias("n")))).alias("m")).select("digest", F.col("m.doc_id").alias("node"), "m.sig", "m.bands", "m.n"))
    keys = classes.select(F.posexplode("bands").alias("band", "key"), "node")
    pivots = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min_by("node", F.xxhash64("key", "node")).alias("pivot")).where("n > 1").drop("n")
    shared = stored(keys.join(pivots, "key"))
    pairs = shared.where("node <> pivot").select(F.greatest("node", "pivot").alias("u"), F.least("node", "pivot").alias("v")).distinct()
    sig = classes.select("node", "sig")
    least = least_estimate(percent / 100)
    estimated = pairs.join(sig.select(F.col("node").alias("u"), F.col("sig").alias("a")), "u").join(sig.select(F.col("node").alias("v"), F.col("sig").alias("b")), "v").withColumn("value", agreement("a", "b"))
    pairs = stored(estimated.where(F.col("value") >= least).select("u", "v", "value"))
    # near copies meet many pivots: the likeliest pair of each first, then those that would still join components
    links = stored(confirmed(pairs.groupBy("u").agg(F.max_by("v", F.struct("value", "v")).alias("v")), docs, percent, doc_id, text))
    found = components(links)
    of = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    rest = pairs.select("u", "v").join(of("u"), "u", "left").join(of("v"), "v", "left").where(F.coalesce("of_u", "u") != F.coalesce("of_v", "v")).select("u", "v")
    links = stored(links.unionByName(confirmed(stored(rest), docs, percent, doc_id, text)))
    found = components(links)
    members = shared.select("key", "band", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    kinds = members.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("key")
    members = stored(members.join(kinds, "key"))
    wanted = members.select("node", "component").distinct()
    light = stored(wanted.join(classes.select("node", "sig", "bands", "n").dropDuplicates(["node"]), "node"))
    rows = stored(suspects(members, light, least, percent))
    near = _picked(docs, rows.select(F.col("node").alias("_node")), doc_id)
    payload = stored(sets(near, doc_id, text).dropDuplicates(["node"]).join(light.drop("n"), "node").withColumn("n", F.size("members").cast("long")))
    more = stored(across(rows, payload, least, percent))
    if not more.isEmpty():
        found = components(links.unionByName(more))
    of = classes.select("digest", "node").join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    some = base.where("digest is not null").select("doc_id", "n_shingles", "digest").join(of, "digest").select("doc_id", "n_shingles", "component_id")
    none = base.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return some.unionByName(none).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents at a similarity of 0.85 or more."""
    return near_duplicates(documents(spark, sf_dir, "doc_id", "text"), percent=85)


def _numbered(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc, text, row): a stored table with each row as a struct, its text, and a number of its own."""
    return stored(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(f"`{text}`").alias("text"), F.monotonically_increasing_id().alias("row")))


def deduplicated(docs: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, all its columns as they came: that of the least id, one without an id only where no other has one.

    Rows are the nodes, whatever their ids: different texts of one id all stay unless they are near-duplicates; of those the one of the least hash of its text stays. Texts
    without a word link with nothing; of those that repeat an id, one stays.
    """
    rows = _numbered(docs, text)
    found = near_duplicates(rows, percent, doc_id="row").select(F.col("doc_id").alias("row"), "component_id", "n_shingles")
    found = found.join(rows.select("row", F.col("doc").getField(doc_id).alias("id"), F.xxhash64("text").alias("hash")), "row")
    wordless = (F.col("n_shingles") == 0) & F.col("id").isNotNull()
    group = (F.when(~wordless, F.col("component_id")).alias("a"), F.when(wordless, F.col("id")).alias("b"))
    least = found.groupBy(*group).agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash", "row")).alias("m")).select("m.row")
    return rows.join(least, "row", "left_semi").select(*(F.col("doc").getField(c).alias(c) for c in docs.columns))
