"""A quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated by temperature.

Random indexing gives every word a sparse index vector from its hash, and every vocabulary word the sum of its neighbours' index vectors in the
sample. Words outside the vocabulary stand for their last letters. Beside the words, their shapes (cases, digits and signs) and two
marks, a word that repeats the one before it and a line that repeats an earlier one, are indexed as well. A document is the mean of its
words' vectors and the mean of its shapes' and marks' vectors.

Everything is fitted on a bounded sample: SAMPLE labelled rows in expectation, chosen by a hash of their id; whole texts. Every text is scored whole
in one pass. Null and empty texts have zero vectors and get the score that the network gives those; repeated rows get equal scores; rows
without a label are scored like others; where no row is labelled, every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import documents, pieces, stored, unit_hash
from claimweave.llm.langid import fold

#: Labelled rows in the sample, the share that calibrates, vocabulary words, classes of other words, classes of shapes, dimensions of a half.
SAMPLE, CALIBRATE, VOCABULARY, OTHERS, SHAPES, WIDTH = 6000, 0.2, 8192, 1024, 512, 64
#: Non-zero entries of an index vector, and neighbours on each side.
NONZERO, WINDOW = 6, 2
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 128, 3e-3, 1e-4
#: Distinct words whose classes a task keeps.
MEMO = 200_000
TASKS = 16


def index_vector(word: str) -> np.ndarray:
    """A sparse vector of signs that depends on the word alone."""
    random = np.random.default_rng(xxhash.xxh64_intdigest(word.encode()))
    out = np.zeros(WIDTH, np.float32)
    out[random.choice(WIDTH, NONZERO, replace=False)] = random.choice((-1.0, 1.0), NONZERO)
    return out


def shape(word: str) -> str:
    """Cases, digits and signs in their order, runs of one kind as one character."""
    out, last = [], ""
    for c in word:
        kind = "a" if c.islower() else "A" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        if kind != last:
            out.append(kind)
            last = kind
    return "".join(out)


class Reader:
    """Classes of words, kept for the words seen so far."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary, self.words = vocabulary, regex.compile(r"[^\x20\x09-\x0D]+").findall
        self.letters = regex.compile(r"[^\p{L}\p{N}]+").sub
        self.clear()

    def clear(self) -> None:
        self.seen: dict[str, int] = {}
        self.body, self.form = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def normal(self, word: str) -> str:
        return self.letters("", word).lower()

    def classes(self, word: str) -> tuple[int, int]:
        w = self.normal(word)
        k = self.vocabulary.get(w)
        return len(self.vocabulary) + xxhash.xxh32_intdigest(w[-3:].encode()) % OTHERS if k is None else k, xxhash.xxh32_intdigest(shape(word).encode()) % SHAPES

    def __call__(self, text: str | None) -> np.ndarray:
        """The numbers of the words of a text, or of a piece of one, in body and form. They hold until the next call."""
        words = self.words(text or "")
        self.first, self.last = (words[0], words[-1]) if words else (None, None)
        new = {w for w in words if w not in self.seen}
        if new:
            if len(self.seen) + len(new) > MEMO:
                self.clear()
                new = set(words)
            pairs = np.array([self.classes(w) for w in new], np.int32).reshape(len(new), 2)
            self.seen.update(zip(new, range(len(self.seen), len(self.seen) + len(new)), strict=True))
            self.body, self.form = np.append(self.body, pairs[:, 0]), np.append(self.form, pairs[:, 1])
        return np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))


def filled_lines(text: str) -> Iterator[str]:
    """The lines of a text that are not blank, one at a time."""
    at = 0
    while at <= len(text):
        end = text.find("\n", at)
        line = text[at : len(text) if end < 0 else end]
        if line.strip():
            yield line
        at = len(text) + 1 if end < 0 else end + 1


@dataclass
class Model:
    vocabulary: dict[str, int]
    words: np.ndarray  # a vector for each vocabulary word and each class of other words
    shapes: np.ndarray  # a vector for each class of shapes, then the two marks
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: tuple[np.ndarray, ...] = ()
    temperature: float = 1.0

    def pooled(self, reader: Reader, text: str | None) -> np.ndarray:
        """The vector of a text, read in pieces: each adds counts of classes, so a long text needs no more room than a piece and a number for each line."""
        bodies, forms, n, doubled, last = np.zeros(len(self.words), np.int64), np.zeros(SHAPES, np.int64), 0, 0, None
        for piece in pieces(text or ""):
            own = reader(piece)
            if len(own):
                bodies += np.bincount(reader.body[own], minlength=len(bodies))
                forms += np.bincount(reader.form[own], minlength=SHAPES)
                doubled += int((own[1:] == own[:-1]).sum()) + (reader.first == last)
                n, last = n + len(own), reader.last
        out = np.zeros(2 * WIDTH)
        if not n:
            return out
        some = np.flatnonzero(bodies)
        out[:WIDTH] = bodies[some] @ self.words[some] / n
        out[WIDTH:] = (forms @ self.shapes[:SHAPES] + doubled * self.shapes[SHAPES]) / n
        lines = np.fromiter(map(xxhash.xxh64_intdigest, filled_lines(text)), np.uint64)
        out[WIDTH:] += (1 - len(np.unique(lines)) / len(lines)) * self.shapes[SHAPES + 1]
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum((x - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2[0]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(model: Model, x: np.ndarray, y: np.ndarray) -> None:
    """Two layers by Adam on the logistic loss, in a fixed order of rows."""
    random = np.random.default_rng(0)
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = (x - model.mean) / model.scale
    p = [random.standard_normal((x.shape[1], HIDDEN)) * np.sqrt(2 / x.shape[1]), np.zeros(HIDDEN), random.standard_normal(HIDDEN) * np.sqrt(1 / HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        order = random.permutation(len(y))
        for at in range(0, len(y), BATCH):
            i = order[at : at + BATCH]
            h = z[i] @ p[0] + p[1]
            a = np.maximum(h, 0)
            d = (sigmoid(a @ p[2] + p[3][0]) - y[i]) / len(i)
            back = np.outer(d, p[2]) * (h > 0)
            grads = [z[i].T @ back + DECAY * p[0], back.sum(axis=0), a.T @ d + DECAY * p[2], np.array([d.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model.layers = tuple(p)


def calibrate(model: Model, x: np.ndarray, y: np.ndarray) -> None:
    """The temperature of the least log loss on rows that the training left out."""
    if not len(y):
        return
    z = model.logits(x)
    loss = {t: -np.log(np.maximum(np.where(y > 0, sigmoid(z / t), sigmoid(-z / t)), 1e-12)).mean() for t in np.geomspace(0.25, 8, 41)}
    model.temperature = float(min(loss, key=loss.get))


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model | None:
    """A model from the rows of docs whose id has a 0 or 1 in labels (of several the largest); None where there is none."""
    spark = docs.sparkSession
    given = labels.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{label}`").cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").groupBy("_id").agg(F.max("_y").alias("_y"))
    n = given.count()
    chosen = given.where(unit_hash(F.col("_id")) < min(1.0, sample / max(n, 1)))
    rows = docs.join(F.broadcast(chosen), F.col(f"`{doc_id}`") == F.col("_id"))  # some `sample` rows, whatever the tables' size
    rows = stored(rows.select(F.col("_id"), F.col(f"`{text}`").alias("text"), "_y", (unit_hash(F.col("_id"), F.lit("calibrate")) >= CALIBRATE).alias("fit")).repartition(TASKS))  # after the join: the scan keeps all its tasks
    words = F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), 0))
    common = rows.where("fit").select(words.alias("w")).select(F.lower(F.regexp_replace("w", r"[^\p{L}\p{N}]+", "")).alias("w")).groupBy("w").count().orderBy(F.desc("count"), "w").limit(VOCABULARY).collect()
    if not common:
        return None
    vocabulary = {x.w: k for k, x in enumerate(common)}
    width = len(vocabulary) + OTHERS
    own = np.stack([index_vector(f"word {k}") for k in range(width)])

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, sums = Reader(vocabulary), np.zeros((width, WIDTH), np.float32)
        for batch in batches:
            for x in batch.column(0):
                for piece in pieces(x.as_py() or "", 1 << 16):  # neighbours across pieces do not count
                    body = reader.body[k] if len(k := reader(piece)) else np.zeros(0, np.int32)
                    for gap in range(1, WINDOW + 1):
                        np.add.at(sums, body[gap:], own[body[:-gap]])
                        np.add.at(sums, body[:-gap], own[body[gap:]])
        yield pa.RecordBatch.from_pydict({"sums": pa.array([sums.tobytes()], pa.binary())})

    sums = np.zeros((width, WIDTH))
    for x in rows.where("fit").select("text").mapInArrow(contexts, "sums binary").collect():  # TASKS rows of a fixed size, at once: one by one, a task would wait for the last
        sums += np.frombuffer(x.sums, np.float32).reshape(width, WIDTH)
    sums -= sums.mean(axis=0)
    vectors = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    model = Model(vocabulary, vectors.astype(np.float32), np.stack([index_vector(f"shape {k}") for k in range(SHAPES + 2)]).astype(np.float64))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(vocabulary)
        for batch in batches:
            x = [model.pooled(reader, t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), *batch.columns[1:]], names=["x", "_y", "fit", "_id"])

    got = rows.select("text", "_y", "fit", "_id").mapInArrow(pool, f"x array<double>, _y int, fit boolean, _id {rows.schema['_id'].dataType.simpleString()}").toPandas().sort_values("_id")
    x, y, fit = np.array(got.x.tolist()), got._y.to_numpy(float), got.fit.to_numpy(bool)
    train(model, x[fit], y[fit])
    calibrate(model, x[~fit], y[~fit])
    return model


def scored(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for each row: the calibrated probability of label 1."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.5).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # arrays and plain values: a broadcast is unpickled by name, and executors have no copy of this class

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**shared.value)
        reader = Reader(model.vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = np.array([model.pooled(reader, t.as_py()) for t in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sigmoid(model.logits(x) / model.temperature))], names=["doc_id", "score"])

    return rows.mapInArrow(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every whole text, learned from labels of folds 0 and 2."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out = scored(docs, learn(docs, labels.where(fold("doc_id", 3) != 1)))
    return out.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
