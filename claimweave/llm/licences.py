"""Licence scans by a positional rare-token index.

1. The frequency of every template word over all texts gives its inverse document frequency; function words are never indexed.
2. A template's rarest words are its index words, and a share of them must agree. So of a file that holds the template, one of the first few of these words must stand in it:
   only they have postings (template, position). A file's licence words look up their postings from the highest such frequency down; a posting's
   relative position (place in the file less place in the template) is where the template would start.
3. The postings of the template's other index words are intersected with that start, give or take SLACK words in all.
4. A candidate counts when its mandatory key phrases stand where the template has them. The contract's phrases are templates whose words must
   all stand, without slack.

The index is a constant of a few kilobytes; each text is scanned whole, in one pass without a shuffle, after one that counts words. Null and empty texts have no
word. Repeated rows are scanned one by one; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import documents
from claimweave.llm.templates import BASE, TEMPLATES, Template

#: A template's index words, the least share of them that must agree, and the words by which places may differ.
RAREST, AGREE, SLACK = 6, 0.6, 3
# Function words, which are never indexed.
FUNCTION_WORDS = frozenset(b"a an and any are as at be been by do for from has have if in is it its may must no not of on or shall should so such that the their they this to under was were which who will with without you your".split())

#: A-Z to a-z, ASCII bytes outside [0-9a-z] to a blank; UTF-8 bytes above 0x7F are word characters.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
Words = list[bytes]


class Entry:
    """A template with its index words: (word, position), the rarest first; so many of them must agree."""

    def __init__(self, template: Template, idf: dict[bytes, float]):
        self.label, self.whole, words = template.label, template.whole, template.text.encode().split()
        at = {w: i for i, w in reversed(list(enumerate(words)))}  # a word's first place
        if template.whole:
            self.chosen = sorted(((w, i) for i, w in enumerate(words)), key=lambda x: (-idf.get(x[0], 0.0), x))
            self.need, self.phrases = len(words), []
        else:
            self.chosen = sorted(((w, i) for w, i in at.items() if w not in FUNCTION_WORDS), key=lambda x: (-idf.get(x[0], 0.0), x))[:RAREST]
            self.need = math.ceil(AGREE * len(self.chosen))
            self.phrases = [(p, _first(words, p)) for p in (x.encode().split() for x in template.phrases)]
        #: Of `need` agreeing words at least one is among these.
        self.anchors = self.chosen[: len(self.chosen) - self.need + 1]


class Index:
    """Postings of the templates' anchors, and what the intersection and the verification need."""

    def __init__(self, templates: tuple[Template, ...] = (*BASE, *TEMPLATES), n_documents: int = 0, frequency: dict[bytes, int] | None = None):
        """frequency: in how many of the documents each template word stands; without it, in how many templates."""
        if frequency is None:
            n_documents, frequency = len(templates), Counter(w for t in templates for w in set(t.text.encode().split()))
        self.idf = {w: math.log((n_documents + 1) / (n + 1)) for w, n in frequency.items()}
        self.entries = [Entry(t, self.idf) for t in templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, e in enumerate(self.entries):
            for w, place in e.anchors:
                self.postings[w].append((k, place))
        self.watched = frozenset(self.postings)
        self.needed = self.watched | {w for e in self.entries for w, _ in e.chosen}

    def candidates(self, at: dict[bytes, list[int]]) -> dict[int, dict[int, float]]:
        """For each template the starts on which enough of its index words agree, with the share that does. at: the places of a text's words."""
        out: dict[int, dict[int, float]] = defaultdict(dict)
        tried: dict[int, set[int]] = defaultdict(set)
        sets: dict[bytes, set[int]] = {}
        for w in sorted(self.watched & at.keys(), key=lambda w: (-self.idf.get(w, 0.0), w)):
            for k, place in self.postings[w]:
                entry = self.entries[k]
                for here in at[w]:
                    start = here - place
                    if start in tried[k]:
                        continue
                    tried[k].add(start)
                    agree = 0
                    for other, its in entry.chosen:
                        if other not in sets:
                            sets[other] = set(at.get(other, ()))
                        agree += any(start + its + d in sets[other] for d in ((0,) if entry.whole else range(-SLACK, SLACK + 1)))
                    if agree >= entry.need:
                        out[k][start] = agree / len(entry.chosen)
        return out

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, str]], dict[str, float]]:
        """The number of words, the contract's places, and the score of each label of the other templates."""
        words = text.translate(FOLD).split()
        present = self.needed.intersection(words)
        base: list[tuple[int, str]] = []
        found: dict[str, float] = {}
        if not present & self.watched:
            return len(words), base, found
        at: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in present:
                at[w].append(i)
        for k, starts in self.candidates(at).items():
            entry = self.entries[k]
            for start, share in starts.items():
                if entry.whole:
                    base.append((start, entry.label))
                elif share > found.get(entry.label, 0.0) and all(any(stands(words, p, start + place + d) for d in range(-SLACK, SLACK + 1)) for p, place in entry.phrases):
                    found[entry.label] = share
        return len(words), sorted(base), found


def stands(words: Words, phrase: Words, i: int) -> bool:
    return i >= 0 and words[i : i + len(phrase)] == phrase


def _first(words: Words, phrase: Words) -> int:
    return next(i for i in range(len(words)) if stands(words, phrase, i))


def frequencies(docs: DataFrame, words: frozenset[bytes], text: str = "text") -> tuple[int, dict[bytes, int]]:
    """The number of rows, and in how many of them each of the words stands. Tasks count; what comes back has a row for each word at most."""
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = Counter(), 0
        for batch in batches:
            for x in batch.column(0).cast(pa.binary()).to_pylist():
                n += 1
                held.update(words.intersection((x or b"").translate(FOLD).split()))
        yield pa.RecordBatch.from_pydict({"word": pa.array([None, *held], pa.binary()), "n": pa.array([n, *held.values()], pa.int64())})

    got = rows.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {None if x.word is None else bytes(x.word): x.n for x in got}
    return found.pop(None, 0), found


def indexed(docs: DataFrame, templates: tuple[Template, ...] = (*BASE, *TEMPLATES), text: str = "text") -> Index:
    """An index whose frequencies are those of all texts."""
    words = frozenset(w for t in templates for w in t.text.encode().split())
    n, found = frequencies(docs, words, text)
    return Index(templates, n, {w: found.get(w, 0) for w in words})


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", index: Index | None = None) -> DataFrame:
    """(doc_id, n_words, places, labels) for each row: places are (start, label) of the contract's phrases, labels (label, score) of templates."""
    index = index or indexed(docs, text=text)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    places = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
    labels = pa.list_(pa.struct([("label", pa.string()), ("score", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                got = [index.scan(x or b"") for x in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([n for n, _, _ in got], pa.int64()), pa.array([[{"start": i, "label": x} for i, x in b] for _, b, _ in got], places), pa.array([[{"label": x, "score": s} for x, s in sorted(f.items())] for _, _, f in got], labels)],
                    names=["doc_id", "n_words", "places", "labels"],
                )

    return rows.mapInArrow(scan, f"doc_id {kind}, n_words long, places array<struct<start:long,label:string>>, labels array<struct<label:string,score:double>>")


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of every whole text; the score is 1 where a phrase of the contract stands, else the best template's."""
    got = scanned(documents(spark, sf_dir, "doc_id", "text"))
    base = F.array_sort(F.array_distinct("places.label"))
    every = F.array_sort(F.array_union(base, F.col("labels.label")))
    score = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("labels.score"), F.lit(0.0)))
    return got.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.start").alias("first_word"), F.array_max("places.start").alias("last_word"), F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))
