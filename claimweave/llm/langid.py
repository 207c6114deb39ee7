"""Language identification by interpolated Kneser-Ney models of characters, one for each language.

Words (runs of letters and marks, lower-cased) are padded by a start and an end, and every character is predicted from the three before it. The
models are fitted on a bounded sample of labelled rows: SAMPLE documents of each language at most, in expectation, chosen by a hash of their
id, whole texts. The grams of each order stand in one sorted array of hashes, with a column of log probabilities for each language. A text's
language is the one of the lowest cross-entropy per character; ties go to the first in code-point order. The temperature of the
scores and each language's rejection bound come from sampled documents that the fit leaves out.

A null text, and one without a letter, is `und` with score 0, as is every text where nothing was learned. Repeated rows are judged one by one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import documents, pieces, unit_hash

ORDER = 4
#: Labelled documents of each language in the sample, and the share of them that calibrates.
SAMPLE, CALIBRATE = 500, 0.2
MOST_LANGUAGES = 1024
#: A language of fewer labelled documents is fitted on all of them, and has no rejection bound.
FEW = 50
#: Words whose scores a task keeps, and scores of windows that it computes at once.
MEMO, CELLS = 200_000, 1 << 21
#: Characters that are read at once.
TEXT = 4 << 20
#: The share of calibration documents of a language that its rejection bound accepts.
ACCEPT = 0.995
START, END = "\x02", "\x03"
WORD = r"\p{L}[\p{L}\p{M}]*"


def gram_hash(codes: np.ndarray, order: int) -> np.ndarray:
    """64-bit hashes of all windows of so many code points."""
    h = np.zeros(max(0, len(codes) - order + 1), np.uint64)
    for k in range(order):
        h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (codes[k : k + len(h)].astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))
        h ^= h >> np.uint64(29)
    return h


@dataclass
class Model:
    """keys[n] and values[n]: sorted hashes of grams of order n + 1 and their log probabilities; of contexts likewise with log weights."""

    languages: list[str]
    keys: list[np.ndarray]
    values: list[np.ndarray]
    context_keys: list[np.ndarray]
    context_values: list[np.ndarray]
    floor: np.ndarray
    temperature: float = 20.0
    bound: np.ndarray | None = None

    def windows(self, codes: np.ndarray) -> np.ndarray:
        """Log probabilities of the last character of each window of ORDER codes: a row for each window, a column for each language."""
        n = len(codes) - ORDER + 1
        out, weight, open_ = np.zeros((n, len(self.languages))), np.zeros((n, len(self.languages))), np.arange(n)
        for order in range(ORDER, 0, -1):
            tail = gram_hash(codes[ORDER - order :], order)[open_]
            at = np.minimum(np.searchsorted(self.keys[order - 1], tail), len(self.keys[order - 1]) - 1)
            found = self.keys[order - 1][at] == tail
            out[open_[found]] = weight[open_[found]] + self.values[order - 1][at[found]]
            open_ = open_[~found]
            if not len(open_):
                return out
            if order > 1:
                context = gram_hash(codes[ORDER - order : -1], order - 1)[open_]
                at = np.minimum(np.searchsorted(self.context_keys[order - 2], context), len(self.context_keys[order - 2]) - 1)
                known = self.context_keys[order - 2][at] == context
                weight[open_[known]] += self.context_values[order - 2][at[known]]
        out[open_] = weight[open_] + self.floor
        return out

    def words(self, words: list[str]) -> np.ndarray:
        """The summed log probabilities of each word. Windows are taken in blocks, so that a long run of letters needs no more room than a block."""
        padded = [START * (ORDER - 1) + w + END for w in words]
        codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(p) for p in padded])
        out, block = np.zeros((len(words), len(self.languages))), max(1024, CELLS // len(self.languages))
        for at in range(0, len(codes) - ORDER + 1, block):
            each = self.windows(codes[at : at + block + ORDER - 1])
            places = np.arange(at, at + len(each))
            word = np.searchsorted(ends, places, "right")
            inside = places + ORDER <= ends[word]  # a window that goes over a word's end belongs to none
            word, each = word[inside], each[inside]
            if len(word):
                cuts = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
                out[word[cuts]] += np.add.reduceat(each, cuts, axis=0)
        return out


def trained(counts: dict[str, Counter]) -> Model:
    """counts: for each language, how often each gram of ORDER characters occurs in padded words."""
    languages = sorted(counts)
    alphabet = {c for grams in counts.values() for g in grams for c in g}
    uniform = 1.0 / (len(alphabet) + 1)
    probability: list[dict[str, np.ndarray]] = [{} for _ in range(ORDER)]
    weight: list[dict[str, np.ndarray]] = [{} for _ in range(ORDER)]  # by the order that is left; contexts of order - 1 characters
    floor = np.full(len(languages), np.log(uniform))
    tables = []
    for language in languages:
        orders = [Counter(), Counter(), Counter(), counts[language]]
        for order in range(ORDER - 1, 0, -1):  # continuation counts: the distinct characters before a gram
            for g in orders[order]:
                orders[order - 1][g[1:]] += 1
        per = []
        for grams in orders:
            n1, n2 = sum(v == 1 for v in grams.values()), sum(v == 2 for v in grams.values())
            discount = min(0.95, max(0.1, n1 / (n1 + 2 * n2) if n1 else 0.5))
            total, kinds = Counter(), Counter()
            for g, v in grams.items():
                total[g[:-1]] += v
                kinds[g[:-1]] += 1
            per.append((grams, discount, total, kinds))
        tables.append(per)

    def p(k: int, gram: str) -> float:
        """The interpolated probability of a gram's last character in language k."""
        value = uniform
        for order in range(1, len(gram) + 1):
            grams, discount, total, kinds = tables[k][order - 1]
            g = gram[len(gram) - order :]
            if n := total.get(g[:-1]):
                value = max(grams.get(g, 0) - discount, 0.0) / n + discount * kinds[g[:-1]] / n * value
        return value

    for k in range(len(languages)):
        for order in range(1, ORDER + 1):
            for g in tables[k][order - 1][0]:
                if g not in probability[order - 1]:
                    probability[order - 1][g] = np.array([p(j, g) for j in range(len(languages))])
            _, discount, total, kinds = tables[k][order - 1]
            for h, n in total.items():
                weight[order - 1].setdefault(h, np.ones(len(languages)))[k] = discount * kinds[h] / n
    keys, values, context_keys, context_values = [], [], [], []
    for order in range(1, ORDER + 1):
        for table, width, to_keys, to_values in ((probability[order - 1], order, keys, values), (weight[order - 1], order - 1, context_keys, context_values)):
            if not width:
                floor = np.log(uniform * table.get("", np.ones(len(languages))))
                continue
            text = list(table)
            h = gram_hash(np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), np.uint32), width)[::width]
            by = np.argsort(h)
            to_keys.append(h[by])
            to_values.append(np.log(np.array([table[g] for g in text]))[by])
    return Model(languages, keys, values, context_keys, context_values, floor)


class Scorer:
    """Cross-entropies of texts, with the scores of the words seen so far."""

    def __init__(self, model: Model):
        self.model, self.find = model, regex.compile(WORD).findall
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For each text, the cross-entropy per character in each language, and its number of characters (0: no letter)."""
        out, length = np.zeros((len(texts), self.scores.shape[1])), np.zeros(len(texts), np.int64)
        held: list[tuple[int, str]] = []
        size = 0
        for k, text in enumerate(texts):  # some megabytes of text at a time, of one or of many
            for piece in pieces(text or ""):
                held.append((k, piece))
                size += len(piece)
                if size >= TEXT:
                    self._add(held, out, length)
                    held, size = [], 0
        self._add(held, out, length)
        return -out / np.maximum(length, 1)[:, None], length

    def _add(self, parts: list[tuple[int, str]], out: np.ndarray, length: np.ndarray) -> None:
        """Add the log probabilities and the characters of pieces to those of their texts."""
        words = [self.find(piece.lower()) for _, piece in parts]
        new = list({w for own in words for w in own if w not in self.index})
        if len(self.index) + len(new) > MEMO:
            self.clear()
            new = list({w for own in words for w in own})
        if new:
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, *(self.model.words(new[at : at + 8192]) for at in range(0, len(new), 8192))])
        for (k, _), own in zip(parts, words, strict=True):
            if own:
                length[k] += sum(map(len, own)) + len(own)
                counts = Counter(own)
                out[k] += np.fromiter(counts.values(), np.float64, len(counts)) @ self.scores[[self.index[w] for w in counts]]


def probabilities(entropy: np.ndarray, temperature: float) -> np.ndarray:
    z = -temperature * (entropy - entropy.min(axis=1, keepdims=True))
    e = np.exp(z)
    return e / e.sum(axis=1, keepdims=True)


def learn(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model | None:
    """A calibrated model from labelled rows; None where they hold no word."""
    rows = labelled.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).where("lang is not null and text is not null")
    sizes = rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return None
    rate = F.element_at(F.create_map(*(F.lit(x) for s in sizes for x in (s.lang, min(1.0, sample / s["count"])))), F.col("lang"))
    few = [s.lang for s in sizes if s["count"] < FEW]
    apart = unit_hash(F.col("doc_id"), F.lit("calibrate")) >= CALIBRATE
    chosen = rows.where(unit_hash(F.col("doc_id")) < rate).withColumn("fit", apart | F.col("lang").isin(few)).withColumn("calibrate", ~apart & ~F.col("lang").isin(few))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, held = regex.compile(WORD).findall, {}
        for batch in batches:
            for x, language in zip(batch.column(0), batch.column(1), strict=True):
                held.setdefault(language.as_py(), Counter()).update(find(x.as_py().lower()))
        for language, words in held.items():
            counts: Counter = Counter()
            for w, n in words.items():
                w = START * (ORDER - 1) + w + END
                for k in range(len(w) - ORDER + 1):
                    counts[w[k : k + ORDER]] += n
            yield pa.RecordBatch.from_pydict({"lang": pa.array([language] * len(counts), pa.string()), "gram": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})

    counts: dict[str, Counter] = {}
    got = chosen.where("fit").select("text", "lang").mapInArrow(grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    for x in got.toLocalIterator():
        counts.setdefault(x.lang, Counter())[x.gram] = x.n
    if not counts:
        return None
    model = trained(counts)
    _calibrate(model, chosen.where("calibrate").select("text", "lang"))
    return model


def _calibrate(model: Model, rows: DataFrame) -> None:
    n = len(model.languages)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            entropy, length = scorer(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(entropy.tolist(), pa.list_(pa.float64())), pa.array(length)], names=["lang", "entropy", "length"])

    got = rows.mapInArrow(score, "lang string, entropy array<double>, length long").where("length > 0").toPandas()
    got = got[got.lang.isin(model.languages)]
    model.bound = np.full(n, np.inf)
    if not len(got):
        return
    entropy, truth = np.array(got.entropy.tolist()).reshape(len(got), n), np.array([model.languages.index(x) for x in got.lang])
    loss = {t: -np.log(np.maximum(probabilities(entropy, t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in (1, 2, 4, 8, 12, 16, 24, 32, 48, 64)}
    model.temperature = float(min(loss, key=loss.get))
    for k in range(n):
        if (own := entropy[truth == k, k]).size:
            model.bound[k] = np.quantile(own, ACCEPT)


def identified(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, accepted) for each row. accepted: the entropy is within the language's bound."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vars(model) if model else None)  # arrays and plain values: a broadcast is unpickled by name, and executors have no copy of this class

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**shared.value) if shared.value else None
        scorer = Scorer(model) if model else None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                name, score, accepted = ["und"] * part.num_rows, np.zeros(part.num_rows), np.zeros(part.num_rows, bool)
                if scorer:
                    entropy, length = scorer(part.column(1).to_pylist())
                    best = entropy.argmin(axis=1)
                    each = np.arange(len(best))
                    some = length > 0
                    score = np.where(some, probabilities(entropy, model.temperature)[each, best], 0.0)
                    accepted = some & (entropy[each, best] <= model.bound[best])
                    name = [model.languages[b] if s else "und" for b, s in zip(best, some, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(name, pa.string()), pa.array(score), pa.array(accepted)], names=["doc_id", "lang_pred", "score", "accepted"])

    return rows.mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double, accepted boolean")


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(f"`{doc_id}`").cast("string")) % n


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from the documents of folds 1 to 4."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    model = learn(docs.where(fold("doc_id", 5) != 0))
    out = identified(docs, model)
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")
