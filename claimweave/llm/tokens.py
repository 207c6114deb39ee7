"""Token counts: pieces are counted once for each distinct pre-token and joined to documents' pre-token frequencies.

No id is kept. The counts of the most frequent pre-tokens, a table of fixed size, go to every task; the other pre-tokens
of each document go through a join. Null and empty texts have no token; special strings count as the library counts them:
one token each. Repeated rows are counted row by row; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections import Counter
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import documents, stored

#: Pre-tokens whose counts go to every task: most entries, and most bytes in all.
HOT_ENTRIES, HOT_BYTES = 200_000, 8 << 20
#: Distinct pre-tokens that a task gathers before it hands on their counts.
HELD = 120_000
#: The split before the merges of byte-level vocabularies, as published with them.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Splitter:
    """A text's pre-tokens and the number of special strings in it, as the library splits it. Vocabularies of another split, or with a normalizer, leave both to the library.

    A compiled pattern splits texts whose characters all have a category in Python's Unicode tables. The pattern's engine has newer tables than
    the library, which take some other characters for letters or numbers; texts with such a character are split by the library.
    """

    def __init__(self, path: str):
        self.library = tokenizers.Tokenizer.from_file(path)
        self.special = tuple(x.content for x in self.library.get_added_tokens_decoder().values())
        self.find = regex.compile(SPLIT).findall
        self.cut = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.known: set[str] = set()
        plan = json.loads(self.library.to_str())
        split = plan["pre_tokenizer"] or {}
        self.published = plan["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)

    def pieces(self, text: str) -> list[str]:
        if not self.published:
            if self.library.normalizer is not None:
                text = self.library.normalizer.normalize_str(text)
            if self.library.pre_tokenizer is None:
                return [text] if text else []
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        if not text.isascii():
            new = set(text) - self.known
            if any(unicodedata.category(c) == "Cn" for c in new):
                return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
            self.known |= new
        return self.find(text)

    def __call__(self, text: str) -> tuple[list[str], int]:
        if self.cut is None or not any(x in text for x in self.special):
            return self.pieces(text), 0
        parts = self.cut.split(text)
        return [p for part in parts for p in self.pieces(part)], len(parts) - 1


def pretoken_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(piece, n): how often each distinct pre-token occurs in all texts. Tasks combine counts before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held = Splitter(path), Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict({"piece": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})
            held.clear()
            return batch

        for batch in batches:
            for x in batch.column(0):
                if x := x.as_py():
                    held.update(split(x)[0])
                if len(held) >= HELD:
                    yield out()
        yield out()

    return docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def piece_counts(pretokens: DataFrame, path: str) -> DataFrame:
    """pretokens with n_pieces: each distinct pre-token is encoded once, its ids are counted and dropped."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        library = tokenizers.Tokenizer.from_file(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                lengths = [len(x) for x in library.encode_batch_fast(part.column(0).to_pylist(), add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lengths, pa.int32())], names=["piece", "n", "n_pieces"])

    return pretokens.mapInArrow(encode, "piece string, n long, n_pieces int")


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", hot_entries: int = HOT_ENTRIES) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row of docs, as the library for the vocabulary at path counts whole texts."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    table = stored(piece_counts(pretoken_counts(rows, path), path))
    hot, size = {}, 0
    # the most frequent ones, however long: a line that all texts repeat would be a hot key of the join
    for x in table.where(F.octet_length("piece") <= HOT_BYTES // 64).orderBy(F.desc("n"), "piece").limit(hot_entries).select("piece", "n_pieces").toLocalIterator():
        size += len(x.piece) * 2
        if size > HOT_BYTES:
            break
        hot[x.piece] = x.n_pieces
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document with what the hot table knows (piece: a key of its own), and one for each other pre-token of it."""
        split, known, nth = Splitter(path), shared.value, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                ids, of, total, piece, n = [], [], [], [], []
                for i, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    pieces, extra = split(x or "")
                    counts = list(map(known.get, pieces))
                    rest = Counter(p for p, c in zip(pieces, counts, strict=True) if c is None) if None in counts else {}
                    ids += [i] * (1 + len(rest))
                    of += [nth] * (1 + len(rest))
                    total += [sum(filter(None, counts)) + extra] + [0] * len(rest)
                    piece += [f"\0{nth}", *rest]
                    n += [len((x or "").encode()), *rest.values()]
                    nth += 1
                yield pa.RecordBatch.from_arrays([pa.array(ids, part.schema.field(0).type), pa.array(of, pa.int64()), pa.array(total, pa.int64()), pa.array(piece, pa.string()), pa.array(n, pa.int64())], names=["doc_id", "nth", "total", "piece", "n"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    parts = rows.mapInArrow(look_up, f"doc_id {kind}, nth long, total long, piece string, n long").withColumn("nth", F.shiftleft(F.spark_partition_id().cast("long"), 36) + F.col("nth"))
    head = F.startswith("piece", F.lit("\0"))
    joined = parts.join(table.select("piece", "n_pieces"), "piece", "left")
    value = F.when(F.col("n_pieces").isNull(), F.col("total")).otherwise(F.col("n") * F.col("n_pieces"))
    out = joined.groupBy("doc_id", "nth").agg(F.sum(F.when(head & F.col("n_pieces").isNull(), F.col("n"))).alias("n_bytes"), F.sum(value).alias("n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens")


def op10_token_counts(spark: SparkSession, sf_dir: str, limit: int = 1024) -> DataFrame:
    """Tokens of every whole text of documents by the byte-level vocabulary of 50,257 ids."""
    counts = token_counts(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
