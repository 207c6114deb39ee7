"""Token ids and counts against the library, on all documents and on texts that are hard to split."""

import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from claimweave.llm import packing, tokens

BPE = public_tokenizers.path("byte_bpe_50k.json")
N = 1_000_000
HARD = [" " * N + "a", "\n" * N, "a" * N, "é" * 1000 + "́" * 1000, "a\U000107bb1 \U000107bb!՘1", "".join(map(chr, range(0xA0, 0x3000))), "x<|endoftext|>y<|endoftext|>", "\t \t" * 5000 + "<|endoftext|>" + " " * 300, "ab 12's'S 'll　  \r\n\r\n end", None, ""]


@pytest.fixture(scope="module")
def texts(spark):
    """All documents of sf0.01, and hard ones with ids below 0; n_tokens and piece clash with columns of results."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    hard = spark.createDataFrame([(-1 - k, t) for k, t in enumerate(HARD)], "doc_id long, text string")
    return docs.unionByName(hard).selectExpr("*", "'own' as n_tokens", "'own' as piece").cache()


@pytest.fixture(scope="module")
def ids(texts):
    library = tokenizers.Tokenizer.from_file(BPE)
    return {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids for r in texts.collect()}


def test_counts_equal_the_library(texts, ids):
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(texts, BPE).collect()}
    assert got == {k: len(v) for k, v in ids.items()}


def test_packed_ids_equal_the_library(texts, ids):
    pieces = packing.packed(texts, BPE).collect()
    at, used = collections.Counter(), collections.Counter()
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        whole = [*ids[p.doc_id], 1]
        assert p.start == at[p.doc_id] and p.doc_tokens == len(whole)
        assert p.ids_crc32 == zlib.crc32(np.array(whole[p.start : p.start + p.length], "<u4").tobytes())
        at[p.doc_id] += p.length
    assert dict(at) == {k: len(v) + 1 for k, v in ids.items()}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == used[p.sequence_id]
        used[p.sequence_id] += p.length
    assert max(used.values()) <= 2048
    padded = sum(2048 - n for n in used.values() if n & (n - 1))
    assert padded < 0.03 * sum(used.values())


def test_other_vocabularies_and_long_lines(spark):
    """A vocabulary with a normalizer and another split is counted as the library does; and a line of many signs that all texts repeat stands in the hot table."""
    path = public_tokenizers.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    texts = [None, "", "Hello, World! It's 2,024 naïve  cafés\n\n", "ÀÉ漢字 😀 x" * 3, "Cafe\u0301 THE the"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect()]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(frame, path).collect()}
    assert got == {k: len(library.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(texts)}
    bpe, line = public_tokenizers.path("byte_bpe_50k.json"), "=" * 3000
    rows = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit(line + "\n"), F.col("id").cast("string")).alias("text"))
    count = {r.doc_id: r.n_tokens for r in tokens.token_counts(rows, bpe).collect()}
    library = tokenizers.Tokenizer.from_file(bpe)
    assert all(count[k] == len(library.encode(f"{line}\n{k}", add_special_tokens=False).ids) for k in range(0, 300, 37))
