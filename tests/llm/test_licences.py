"""Licence scans against a scan without an index, over whole tables and hand-made texts."""

import math
import re

import pytest

from claimweave.llm import licences
from claimweave.llm.licences import AGREE, BASE, SLACK, TEMPLATES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}


def words_of(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_base(w):
    return sorted((i, label) for label, p in PHRASES.items() for i in range(len(w)) if w[i : i + len(p)] == p)


def brute_labels(w, index):
    """Every start of every template is tried; the index's choice of words is all that is taken from it."""
    raw = [x.encode() for x in w]
    found = {}
    for e in index.entries:
        if e.whole:
            continue
        for start in range(-max(i for _, i in e.chosen) - SLACK, len(raw)):
            agree = sum(x in raw[max(0, start + i - SLACK) : max(0, start + i + SLACK + 1)] for x, i in e.chosen)
            if agree >= math.ceil(AGREE * len(e.chosen)) and all(any(raw[max(0, at) : at + len(p)] == p for at in range(start + i - SLACK, start + i + SLACK + 1) if at >= 0) for p, i in e.phrases):
                found[e.label] = max(found.get(e.label, 0), agree / len(e.chosen))
    return found


@pytest.fixture(scope="module")
def scans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    odd = [(-1, None), (-2, ""), (-3, "All Rights Reserved " * 200_000), (-4, "cc by cc-by CC_BY"), (-5, "x" * 3_000_000), (-6, TEMPLATES[0].text + " é漢"), (-6, TEMPLATES[0].text + " é漢")]
    rows = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string")).selectExpr("*", "'own' as labels", "7 as n_words").cache()
    index = licences.indexed(rows)
    return rows.collect(), index, licences.scanned(rows, index=index).collect()


def test_base_columns_of_all_documents(scans):
    rows, _, got = scans
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for r in rows:
        w = words_of(r.text)
        assert by_id[r.doc_id].n_words == len(w) and [tuple(x) for x in by_id[r.doc_id].places] == brute_base(w)


def test_labels_of_short_documents(scans):
    rows, index, got = scans
    by_id = {r.doc_id: {x.label: x.score for x in r.labels} for r in got}
    licensed = [r for r in rows if by_id[r.doc_id]]
    assert licensed
    for r in [*licensed, *rows[:40]]:
        w = words_of(r.text)
        if len(w) < 400:
            assert by_id[r.doc_id] == pytest.approx(brute_labels(w, index)), r.doc_id


def test_every_template_is_found(scans):
    index = scans[1]
    assert len({t.label for t in TEMPLATES}) >= 60
    for t in TEMPLATES:
        text = f"intro words {t.text.upper()} and an end".encode()
        assert index.scan(text)[2].get(t.label) == 1.0
    for e in index.entries:
        assert e.anchors and not (licences.FUNCTION_WORDS & {w for w, _ in e.chosen} and not e.whole)


def test_kin_are_told_apart(scans):
    index = scans[1]
    labels = lambda text: set(index.scan(text.encode())[2])
    assert labels("Licensed under the Apache License, Version 2.0.") == {"apache-2.0"}
    assert "cc-by-nc-sa-4.0" in labels("licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License") - {"cc-by-4.0", "cc-by-sa-4.0"}
    assert not labels("the version of this software that any person may use with public license talk") and index.scan(b"") == (0, [], {})


def test_frequencies_count_rows(spark):
    frame = spark.createDataFrame([("license license",), ("License of",), (None,), ("",)], "text string")
    assert licences.frequencies(frame, frozenset([b"license", b"warranty"])) == (4, {b"license": 2})
    empty = frame.limit(0)
    assert licences.frequencies(empty, frozenset([b"license"]))[0] == 0 and licences.scanned(empty.selectExpr("1 as doc_id", "text")).count() == 0
