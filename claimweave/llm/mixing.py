"""Mixing sources to target weights by entropy balancing.

Every document gets a rate r that keeps a divergence from 1 small, sum of b (r ln r - r) with b the root of its size, under one token
constraint for each source and 0 <= r <= 3. The dual is convex in one number for each source; its Newton steps are aggregates over
(source, size) cells, safeguarded by a bracket. Rates are exp(lambda size / b), at most 3, so a rate depends on source and size alone.
Rates become whole copies by a hash of the document; an offset for each source, found by rounds of histograms, and repairs
with documents that still fit bring the words taken up to the target. Documents are never gathered, ordered or ranked in one task.

Null sources are a source of their own, in the last place. Null and empty texts have size 0 and cost nothing. Repeated rows (same id and
text) get the same number of copies; one copy more goes to a document only where all its rows together bring the source nearer to its target. mixed() puts its
results in the place of columns of their names; mixed_copies() has no column of its own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import SPACES, documents, reliable, unit_hash

#: Weights of the sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A document's most copies, and a target's most multiple of its source's size.
MOST = 3
#: Weights are a setting kept in the driver: more sources than this are refused.
MOST_SOURCES = 4096
REPAIRS, NEWTON = 5, 40
#: A search's bins over all sources in one round, most of one source, and the parts of a range that the last round tells apart.
ALL_BINS, MOST_BINS, PARTS = 40_000, 2048, 1 << 21
#: Repairs end where every source lies within this part of its target.
CLOSE = 5e-4
#: Partitions of the cells: there are as many rows as pairs of a source and a size.
CELL_TASKS = 16
STEPS = 3.0  # thresholds of copies lie in (-STEPS, STEPS]


def size_of(text: str = "text") -> Column:
    trimmed = F.btrim(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def shares(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> list[float]:
    """Targets of sources in their order: shares of the total by repeating weights, none above most times its size."""
    weight = [weights[k % len(weights)] for k in range(len(sizes))]
    target, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(weight[k] for k in free)
        above = [k for k in free if left * weight[k] / total > most * sizes[k]]
        if not above:
            for k in free:
                target[k] = left * weight[k] / total
            break
        for k in above:
            target[k] = float(most * sizes[k])
        left -= sum(target[k] for k in above)
        free.difference_update(above)
    return target


@dataclass
class Source:
    """What is solved for one source."""

    size: int
    target: float
    scale: float = 1.0  # a typical size, so that the tilt is near 1
    tilt: float = 0.0
    offset: float = 0.0
    repairs: list[tuple[float, float]] = field(default_factory=list)  # largest size, threshold of the hash
    taken: float = 0.0
    extra: int | None = None  # the key of a document that gets one copy more


class Mix:
    """Solved parameters, and the columns that apply them to any rows of the same documents."""

    def __init__(self, spark: SparkSession, sources: dict[str | None, Source]):
        self.spark, self.sources = spark, sources

    def _table(self) -> DataFrame:
        rows = [(k, s.size, s.target, s.scale, s.tilt, s.offset, s.target - s.taken, s.extra, *(x for j in range(REPAIRS) for x in (s.repairs[j] if j < len(s.repairs) else (0.0, 0.0)))) for k, s in self.sources.items()]
        names = "_k string, source_size long, target double, _scale double, _tilt double, _offset double, _left double, _extra long, " + ", ".join(f"_most{j} double, _below{j} double" for j in range(REPAIRS))
        return self.spark.createDataFrame(rows, names)

    def joined(self, rows: DataFrame, source: str) -> DataFrame:
        """rows with their source's parameters: a broadcast of MOST_SOURCES rows at most."""
        return rows.join(F.broadcast(self._table()), F.col(f"`{source}`").eqNullSafe(F.col("_k")), "left")

    @staticmethod
    def rate(size: str = "size") -> Column:
        return F.least(F.lit(float(MOST)), F.exp(F.least(F.lit(50.0), F.col("_tilt") * F.sqrt(F.col(size) / F.col("_scale")))))

    @staticmethod
    def copies(key: Column, size: str = "size", repairs: int = REPAIRS) -> Column:
        n = F.greatest(F.lit(0), F.least(F.lit(MOST), F.floor(Mix.rate(size) + unit_hash(key) + F.col("_offset")))).cast("int")
        one = lambda held: F.when(held, 1).otherwise(0)
        for j in range(repairs):  # n stands once in each step: the expression grows by a term, not twofold
            n = F.least(F.lit(MOST), n + one((F.col(size) > 0) & (F.col(size) <= F.col(f"_most{j}")) & (unit_hash(key, F.lit(j)) < F.col(f"_below{j}"))))
        return F.least(F.lit(MOST), n + one(key == F.col("_extra")))


def solve(rows: DataFrame) -> Mix:
    """rows: source, size (long) and key (long), read some thirty times: give a table, not a long plan."""
    spark = rows.sparkSession
    cells = reliable(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")).coalesce(CELL_TASKS))
    per = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("size"), F.sum(F.col("n") * F.col("size") * F.col("size").cast("double")).alias("square")).limit(MOST_SOURCES + 1).collect()
    if len(per) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    per.sort(key=lambda x: (x.source is None, x.source or ""))
    targets = shares([x.size for x in per])
    mix = Mix(spark, {x.source: Source(x.size, t, max(1.0, x.square / x.size if x.size else 1.0)) for x, t in zip(per, targets, strict=True)})
    _newton(mix, cells)
    _offsets(mix, rows)
    for j in range(REPAIRS):
        if all(s.target - s.taken <= CLOSE * s.target for s in mix.sources.values()):
            return mix
        _repair(mix, rows, j)
    _nearest(mix, rows)
    return mix


def _newton(mix: Mix, cells: DataFrame) -> None:
    """Newton's method on the dual of every source at once; a bisection step where Newton leaves the bracket."""
    bracket = {k: [-60.0, 60.0] for k in mix.sources}
    open_ = set()
    for k, s in mix.sources.items():
        if s.target >= MOST * s.size:
            s.tilt = math.inf if s.size else 0.0
        elif s.size:
            s.tilt = math.log(s.target / s.size) if s.target > 0 else -60.0
            open_.add(k)
    z = F.sqrt(F.col("size") / F.col("_scale"))
    # a start from sizes in some hundred classes for each source: the same dual, coarser
    classes = mix.joined(cells.where("size > 0"), "source").groupBy("source", F.floor(F.log2("size") * 8).alias("c")).agg(F.sum(F.col("n") * F.col("size")).alias("tokens"), F.sum(F.col("n") * F.col("size") * z).alias("z"))
    coarse: dict[str | None, list[tuple[float, float]]] = {}
    for x in classes.toLocalIterator():
        coarse.setdefault(x.source, []).append((float(x.tokens), x.z / x.tokens))
    for k in open_:
        mix.sources[k].tilt = _bisected(coarse[k], mix.sources[k].target)
    for _ in range(NEWTON):
        if not open_:
            break
        tokens = F.col("n") * F.col("size") * Mix.rate()
        # the gradient's sum, and the Hessian over rates below the cap
        got = mix.joined(cells, "source").groupBy("source").agg(F.sum(tokens).alias("f"), F.sum(F.when(Mix.rate() < MOST, tokens * z).otherwise(0.0)).alias("slope")).collect()
        for x in got:
            if x.source not in open_:
                continue
            s, low_high = mix.sources[x.source], bracket[x.source]
            miss = x.f - s.target
            if abs(miss) <= 1e-7 * s.target + 1e-6:
                open_.discard(x.source)
                continue
            low_high[miss > 0] = s.tilt
            step = s.tilt - miss / x.slope if x.slope > 0 else math.nan
            s.tilt = step if low_high[0] < step < low_high[1] else sum(low_high) / 2
            if low_high[1] - low_high[0] < 1e-12:
                open_.discard(x.source)
    for s in mix.sources.values():
        s.tilt = min(s.tilt, 1e6)


def _bisected(classes: list[tuple[float, float]], target: float) -> float:
    low, high = -60.0, 60.0
    for _ in range(60):
        middle = (low + high) / 2
        if sum(t * min(MOST, math.exp(min(50.0, middle * z))) for t, z in classes) > target:
            high = middle
        else:
            low = middle
    return low


def _search(mix: Mix, steps: DataFrame, low: float, high: float, room: dict[str | None, float]) -> dict[str | None, tuple[float, float]]:
    """For each source the largest threshold (to a fine bin's edge) up to which steps sum to no more than room, and that sum.

    steps: source, at (double), size. Each level counts the steps by bin within the bin that the last level chose.
    """
    spark = mix.spark
    span = {k: (low, high, 0.0) for k in room}
    n = max(64, min(MOST_BINS, ALL_BINS // max(1, len(room))))
    for _ in range(math.ceil(math.log(PARTS) / math.log(n))):
        table = spark.createDataFrame([(k, a, b, s) for k, (a, b, s) in span.items()], "_s string, _a double, _b double, _done double")
        bins = steps.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("_s"))).where("at >= _a and at < _b").select("source", F.least(F.lit(n - 1), F.floor((F.col("at") - F.col("_a")) / (F.col("_b") - F.col("_a")) * n)).cast("int").alias("bin"), "size")
        counts: dict[str | None, dict[int, int]] = {}
        for x in bins.groupBy("source", "bin").agg(F.sum("size").alias("size")).toLocalIterator():
            counts.setdefault(x.source, {})[x.bin] = x.size
        for k, (a, b, done) in span.items():
            width, chosen = (b - a) / n, n
            for i in range(n):
                if done + counts.get(k, {}).get(i, 0) > room[k]:
                    chosen = i
                    break
                done += counts.get(k, {}).get(i, 0)
            span[k] = (a + chosen * width, a + (chosen + 1) * width, done) if chosen < n else (b, b, done)
        for k, (a, b, done) in span.items():
            if a == b:
                span[k] = (a, a + 1e-300, done)
    return {k: (a, done) for k, (a, _, done) in span.items()}


def _offsets(mix: Mix, rows: DataFrame) -> None:
    steps = mix.joined(rows, "source").select("source", "size", F.explode(F.array(*(F.lit(float(k)) - Mix.rate() - unit_hash(F.col("key")) for k in range(1, MOST + 1)))).alias("at"))
    room = {k: s.target for k, s in mix.sources.items()}
    for k, (at, done) in _search(mix, steps, -STEPS - 1, STEPS, room).items():
        s = mix.sources[k]
        full = s.target >= MOST * s.size
        s.offset, s.taken = (STEPS, float(MOST * s.size)) if full else (math.nextafter(at, -math.inf), float(done))


def _repair(mix: Mix, rows: DataFrame, j: int) -> None:
    left = {k: s.target - s.taken for k, s in mix.sources.items()}
    for k, s in mix.sources.items():
        s.repairs.append((left[k], 0.0))
    near = mix.joined(rows, "source").where((F.col("size") > 0) & (F.col("size") <= F.col(f"_most{j}")) & (Mix.copies(F.col("key"), repairs=j) < MOST))
    steps = near.select("source", "size", unit_hash(F.col("key"), F.lit(j)).alias("at"))
    for k, (at, done) in _search(mix, steps, 0.0, 1.0, left).items():
        s = mix.sources[k]
        s.repairs[j], s.taken = (left[k], at), s.taken + done


def _nearest(mix: Mix, rows: DataFrame) -> None:
    """One copy more, beyond the target, where that ends nearer to it: of the document whose size is the nearest to what is left."""
    free = mix.joined(rows, "source").where((F.col("size") > 0) & (Mix.copies(F.col("key")) < MOST))
    best = free.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("_left")).alias("off"), "size", "key")).alias("m")).select("source", "m.*")
    chosen = [x for x in best.toLocalIterator() if x.off < mix.sources[x.source].target - mix.sources[x.source].taken]
    if not chosen:
        return
    keys = mix.spark.createDataFrame([(x.source, x.key) for x in chosen], "_s string, _chosen long")  # one for each source
    repeated = rows.join(F.broadcast(keys), F.col("source").eqNullSafe(F.col("_s")) & (F.col("key") == F.col("_chosen"))).groupBy("source").agg(F.sum("size").alias("size"))
    together = {x.source: x.size for x in repeated.collect()}
    for x in chosen:
        s = mix.sources[x.source]
        if abs(together[x.source] - (s.target - s.taken)) < s.target - s.taken:
            s.extra, s.taken = x.key, s.taken + together[x.source]


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs with size, source_size, target and copies; copies is 0 for a document that the mix leaves out."""
    results = ("size", "source_size", "target", "copies")
    rows = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in results), size_of(text).alias("size"), F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("_key"))
    mix = solve(reliable(rows.select(F.col(f"`{source}`").cast("string").alias("source"), "size", F.col("_key").alias("key"))))
    out = mix.joined(rows, source)
    return out.select(*(f"`{c}`" for c in rows.columns if c != "_key"), "source_size", "target", Mix.copies(F.col("_key")).alias("copies"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    out = mixed(documents(spark, sf_dir, "doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each document as often as its copies; all its columns as they came, whatever their names."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), *(F.col(f"`{c}`").alias(n) for c, n in ((doc_id, "doc_id"), (text, "text"), (source, "source"))))
    out = mixed(rows).where("copies > 0").select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*(F.col("_doc").getField(c).alias(c) for c in docs.columns))
