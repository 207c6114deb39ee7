"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

Texts longer than a window give whole windows and one remainder. Remainders meet in groups of a fixed
size inside each task, in the order of the input: no shuffle, and memory that does not grow with the data. In a group, every
remainder starts as a partial partition of its own; the two partitions with the largest imbalance merge, the heaviest part of
one with the lightest of the other, until one near-equal partition is left. If its heaviest window exceeds the capacity, the number
of windows rises and the group is dealt again.

A null or empty text has the end id only. Repeated rows are packed one by one. Extra columns are ignored. Texts of any length are encoded whole:
where the fast encoder's pattern cannot be matched (a million blanks in a row exhaust its stack), the library itself encodes the text.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import documents

CAPACITY = 2048
#: Remainders dealt together; more make less padding, and work grows with the square.
GROUP = 1024
#: Remainders are cut to pieces of this part of a window at most: pieces that divide it leave small differences.
PIECES = 4


def encoder(path: str) -> tiktoken.Encoding:
    """The byte-level vocabulary of a tokenizers file, with that library's ids and its default for special strings."""
    spec = json.load(open(path))
    # Byte-level vocabularies print each byte as one character: printable Latin-1 as itself, the rest from U+0100 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding(base64.b16encode(path.encode()).decode(), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


class Encoder:
    """The ids of texts as the library for the vocabulary gives them."""

    def __init__(self, path: str):
        self.path, self.fast, self.library = path, encoder(path), None

    def __call__(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all", disallowed_special=())
        except ValueError:  # the pattern's stack is exhausted
            if self.library is None:
                self.library = tokenizers.Tokenizer.from_file(self.path)
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


def differenced(sizes: list[int], n_windows: int) -> tuple[np.ndarray, np.ndarray]:
    """Multiway differencing: the window of each size, and the windows' loads.

    A partial partition is its loads in descending order, with the sizes in each part; only the non-zero parts are held.
    """
    heap = []
    parts: list[tuple[list[int], list[list[int]]]] = []
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        parts.append(([sizes[i]], [[i]]))
        heap.append((-sizes[i], len(parts) - 1))
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = parts[heapq.heappop(heap)[1]], parts[heapq.heappop(heap)[1]]
        joined = _merged(a, b, n_windows)
        parts.append(joined)
        spread = joined[0][0] - (joined[0][-1] if len(joined[0]) == n_windows else 0)
        heapq.heappush(heap, (-spread, len(parts) - 1))
    loads, members = parts[heap[0][1]]
    at = np.zeros(len(sizes), np.int64)
    for w, inside in enumerate(members):
        at[inside] = w
    return at, np.array(loads + [0] * (n_windows - len(loads)))


def _merged(a, b, n_windows: int):
    """The parts of a and b joined in opposite order: the heaviest of one with the lightest, first of all the empty, of the other."""
    over = max(0, len(a[0]) + len(b[0]) - n_windows)  # so many parts of a and b meet; the other parts meet an empty one
    loads, members = a[0][: len(a[0]) - over] + b[0][: len(b[0]) - over], a[1][: len(a[1]) - over] + b[1][: len(b[1]) - over]
    for k in range(over):
        i, j = len(a[0]) - over + k, len(b[0]) - 1 - k
        loads.append(a[0][i] + b[0][j])
        members.append(a[1][i] + b[1][j])
    order = sorted(range(len(loads)), key=lambda k: -loads[k])
    return [loads[k] for k in order], [members[k] for k in order]


def windows(sizes: list[int], capacity: int = CAPACITY) -> np.ndarray:
    """The window of each size, from 0; none holds more than capacity."""
    if not sizes:
        return np.zeros(0, np.int64)
    count = -(-sum(sizes) // capacity)
    while True:
        at, loads = differenced(sizes, count)
        if loads.max() <= capacity:
            return at
        count += max(1, count // 200)


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, group: int = GROUP, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Sequence ids hold the task's number above bit 32, as the order of rows within a scan's split is fixed; they have gaps between tasks.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind, piece = rows.schema["doc_id"].dataType.simpleString(), max(1, capacity // PIECES)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, base, number = Encoder(path), TaskContext.get().partitionId() << 32, 0
        out: list[list] = [[] for _ in names]
        held: list[tuple] = []
        waiting = 0

        def add(*row) -> None:
            for column, x in zip(out, row, strict=True):
                column.append(x)

        def deal() -> None:
            nonlocal number, waiting
            filled: dict[int, int] = {}
            at = windows([x[2] for x in held], capacity)
            for x, w in zip(held, at.tolist(), strict=True):
                add(*x, base + number + w, filled.get(w, 0))
                filled[w] = filled.get(w, 0) + x[2]
            number += int(at.max()) + 1 if len(at) else 0
            held.clear()
            waiting = 0

        def batch(schema: pa.Schema) -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(out[0], schema.field(0).type), *(pa.array(x, pa.int64()) for x in out[1:])], names=names)
            for x in out:
                x.clear()
            return made

        schema = None
        for arrived in batches:
            schema = arrived.schema
            for i, x in zip(arrived.column(0), arrived.column(1), strict=True):
                i = i.as_py()
                ids = np.append(tokens(x.as_py() or ""), np.uint32(end_id)).astype("<u4")
                n = len(ids)
                whole = n - n % capacity
                for start in range(0, whole, capacity):
                    add(i, start, capacity, zlib.crc32(ids[start : start + capacity]), n, base + number, 0)
                    number += 1
                for start in range(whole, n, piece):
                    part = ids[start : start + piece]
                    held.append((i, start, len(part), zlib.crc32(part), n))
                waiting += whole < n
                if waiting >= group:
                    deal()
                if len(out[0]) >= 8192:
                    yield batch(schema)
        if schema is not None:
            deal()
            yield batch(schema)

    return rows.mapInArrow(pack, f"doc_id {kind}, " + ", ".join(f"{x} long" for x in names[1:]))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2,048 tokens at most; only those that are not full are padded."""
    return packed(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
