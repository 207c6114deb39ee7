"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text (runs of letters, lower-cased) and what longer words begin with (PREFIXES letters); a term's value is log2(1 + occurrences). They are hashed to BUCKETS,
and the TERMS buckets enter the model whose frequencies differ most, for their error, between the labels. Besides a weight for each, the machine
learns a vector of RANK numbers: the product of two terms' vectors is the weight of their meeting in one text, so that an insult beside the name of a group counts for more
than either alone. It is trained by Adam on the logistic loss, and a temperature is fitted on rows that the training leaves out.

It is fitted on a bounded sample: SAMPLE labelled rows in expectation, chosen by a hash of their id, whole texts. Texts are read in blocks, so that a long one is never a list of its
words. Null and empty texts, and those without a letter, have no terms and get the machine's bias; repeated rows get equal scores; a row without a label is scored like
others; an id with several labels has the largest; where nothing is labelled every score is 0. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import documents, pieces, stored, unit_hash
from claimweave.llm.langid import fold

#: Labelled rows in the sample, the share that calibrates, hash buckets, terms in the model, texts that a term has to stand in.
SAMPLE, CALIBRATE, BUCKETS, TERMS, LEAST = 12_000, 0.2, 1 << 22, 4096, 3
PREFIXES = (4, 5, 6, 7, 8)
RANK, EPOCHS, BATCH, RATE, DECAY = 8, 30, 128, 0.02, 2e-4
#: Distinct words whose terms a task keeps.
MEMO = 200_000
TASKS = 16
WORD = r"\p{L}+"


def bucket(term: str) -> int:
    return xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass")) % BUCKETS


def terms(word: str) -> list[int]:
    """The buckets of a word and of what it begins with; a mark parts a beginning from a whole word."""
    return [bucket(word), *(bucket(word[:n] + "+") for n in PREFIXES if len(word) > n)]


class Reader:
    """Terms of texts, with those of the words seen so far. known: the buckets that count, in order; None: all."""

    def __init__(self, known: np.ndarray | None = None):
        self.find = regex.compile(WORD).findall
        self.place = None if known is None else {int(b): k for k, b in enumerate(known)}
        self.seen: dict[str, tuple[int, ...]] = {}

    def of(self, word: str) -> tuple[int, ...]:
        found = self.seen.get(word)
        if found is None:
            found = tuple(terms(word)) if self.place is None else tuple(self.place[b] for b in terms(word) if b in self.place)
            if len(self.seen) >= MEMO:
                self.seen.clear()
            self.seen[word] = found
        return found

    def __call__(self, text: str | None) -> Counter:
        """How often each term occurs."""
        words: Counter = Counter()
        for piece in pieces(text or ""):
            words.update(self.find(piece.lower()))
        out: Counter = Counter()
        for word, n in words.items():
            for term in self.of(word):
                out[term] += n
        return out


def machine(x: np.ndarray, model: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The machine's outputs for rows of values, and the rows' sums of vectors."""
    sums = x @ model["vectors"]
    return model["bias"] + x @ model["weights"] + 0.5 * ((sums**2).sum(axis=1) - (x**2) @ (model["vectors"] ** 2).sum(axis=1)), sums


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -80, 80)))


def dense(rows: list[tuple[np.ndarray, np.ndarray]], width: int) -> np.ndarray:
    """Rows of (places, values) as a matrix."""
    out = np.zeros((len(rows), width), np.float32)
    for k, (at, values) in enumerate(rows):
        out[k, at] = values
    return out


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, width: int) -> dict[str, np.ndarray]:
    """Weights and vectors by Adam on the logistic loss, in a fixed order of rows."""
    random = np.random.default_rng(0)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    model = {"bias": np.array(np.log(share / (1 - share)), np.float32), "weights": np.zeros(width, np.float32), "vectors": (0.01 * random.standard_normal((width, RANK))).astype(np.float32)}
    m, v, step = {k: np.zeros_like(a) for k, a in model.items()}, {k: np.zeros_like(a) for k, a in model.items()}, 0
    for epoch in range(EPOCHS):
        order = random.permutation(len(y))
        for at in range(0, len(y), BATCH):
            i = order[at : at + BATCH]
            x = dense([rows[k] for k in i], width)
            z, sums = machine(x, model)
            d = ((sigmoid(z) - y[i]) / len(i)).astype(np.float32)
            # the slope of a vector: x (sum - x vector)
            grads = {"bias": d.sum(), "weights": x.T @ d + DECAY * model["weights"], "vectors": x.T @ (d[:, None] * sums) - ((x**2).T @ d)[:, None] * model["vectors"] + DECAY * model["vectors"]}
            step += 1
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                model[k] = model[k] - RATE * (1 - epoch / EPOCHS) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> dict[str, np.ndarray] | None:
    """A machine from the rows of docs whose id has a 0 or 1 in labels; None where there is none. Plain arrays, so that workers need no copy of this package."""
    given = labels.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{label}`").cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").groupBy("_id").agg(F.max("_y").alias("_y"))
    n = given.count()
    chosen = given.where(unit_hash(F.col("_id")) < min(1.0, sample / max(n, 1)))
    rows = docs.join(F.broadcast(chosen), F.col(f"`{doc_id}`") == F.col("_id"))  # some `sample` rows, whatever the tables' size
    rows = stored(rows.select("_id", F.col(f"`{text}`").cast("string").alias("text"), "_y", (unit_hash(F.col("_id"), F.lit("calibrate")) >= CALIBRATE).alias("fit")).repartition(TASKS))
    sizes = {r._y: r["count"] for r in rows.where("fit").groupBy("_y").count().collect()}
    if not sizes:
        return None

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, counts = Reader(), (Counter(), Counter())
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                counts[y].update(reader(x.as_py()).keys())
        for y, own in enumerate(counts):
            yield pa.RecordBatch.from_pydict({"term": pa.array(own.keys(), pa.int64()), "label": pa.array([y] * len(own), pa.int32()), "n": pa.array(own.values(), pa.int64())})

    half, clean, toxic = F.lit(0.5), float(sizes.get(0, 0)), float(sizes.get(1, 0))
    found = rows.where("fit").select("text", "_y").mapInArrow(presence, "term long, label int, n long").groupBy("term").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("q"))
    odds = F.log((F.col("p") + half) / (toxic + half - F.col("p") + half)) - F.log((F.col("q") + half) / (clean + half - F.col("q") + half))
    sure = F.abs(odds) / F.sqrt(1 / (F.col("p") + half) + 1 / (F.col("q") + half))
    known = np.sort(np.array([r.term for r in found.where(F.col("p") + F.col("q") >= LEAST).orderBy(sure.desc(), "term").limit(TERMS).collect()], np.int64))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(known)
        for batch in batches:
            got = [reader(x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([list(c.keys()) for c in got], pa.list_(pa.int32())), pa.array([list(c.values()) for c in got], pa.list_(pa.int64())), *batch.columns[1:]], names=["places", "n", "_y", "fit", "_id"])

    got = rows.select("text", "_y", "fit", "_id").mapInArrow(read, f"places array<int>, n array<long>, _y int, fit boolean, _id {rows.schema['_id'].dataType.simpleString()}").orderBy("_id").toPandas()
    values = [(np.asarray(a, np.int64), np.log2(1 + np.asarray(c, np.float32))) for a, c in zip(got.places, got.n, strict=True)]
    y, fit = got._y.to_numpy(np.float32), got.fit.to_numpy(bool)
    model = train([x for x, f in zip(values, fit, strict=True) if f], y[fit], len(known))
    return model | {"known": known, "temperature": np.array(_temperature(model, [x for x, f in zip(values, fit, strict=True) if not f], y[~fit], len(known)))}


def _temperature(model: dict[str, np.ndarray], rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, width: int) -> float:
    """That of the least log loss on rows that the training left out."""
    if not len(y):
        return 1.0
    z = np.concatenate([machine(dense(rows[at : at + 512], width), model)[0] for at in range(0, len(y), 512)])
    loss = {t: -np.log(np.maximum(np.where(y > 0, sigmoid(z / t), sigmoid(-z / t)), 1e-12)).mean() for t in np.geomspace(0.25, 8, 41)}
    return float(min(loss, key=loss.get))


def scored(docs: DataFrame, model: dict[str, np.ndarray] | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for each row: the calibrated probability of label 1."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # TERMS weights and vectors, whatever the tables' size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        reader = Reader(model["known"])
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                got = [reader(x.as_py()) for x in part.column(1)]
                x = dense([(np.fromiter(c.keys(), np.int64, len(c)), np.log2(1 + np.fromiter(c.values(), np.float32, len(c)))) for c in got], len(model["known"]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sigmoid(machine(x, model)[0].astype(np.float64) / model["temperature"]), pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every whole text, learned from labels of folds 0, 1 and 3."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = scored(docs, learn(docs, labels.where(fold("doc_id", 4) != 2)))
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
