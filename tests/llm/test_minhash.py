"""Near-duplicates where ids repeat with other texts, and tiles of long texts, against brute force."""

import random

from claimweave.llm import minhash


def shingles(text):
    w = text.split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def expected(texts, percent, ids):
    """Components of rows by their links and by equal ids: the least id of each."""
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if ids[i] == ids[j] or 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for k, i in enumerate(ids):
        least[root(k)] = min(i, least.get(root(k), i))
    return [least[root(k)] for k in range(len(texts))]


def edited(n, words, seed):
    """Copies of one text with 3 to 12 words changed: many lie close to the threshold, so that pivots miss some links."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(r.randint(3, 12)):
            own[r.randrange(words)] = f"x{r.randrange(10**9)}"
        out.append(" ".join(own))
    return out


def test_ids_that_repeat_with_other_texts(spark, seed=1):
    texts = edited(160, 300, seed)
    r = random.Random(seed + 100)
    other = [" ".join(f"y{r.randrange(10**9)}" for _ in range(300)) for _ in texts]
    rows = [(k, t) for k, t in enumerate(texts)] + [(k, t) for k, t in enumerate(other)]
    want = expected([t for _, t in rows], 85, [k for k, _ in rows])
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.component_id) for r in got} == {(k, c) for (k, _), c in zip(rows, want, strict=True)}
    # the same components as without the other texts
    alone = minhash.near_duplicates(spark.createDataFrame(rows[:160], "doc_id long, text string"), 85).collect()
    assert {(r.doc_id, r.component_id) for r in alone} == {(r.doc_id, r.component_id) for r in got}


def test_tiles_in_parts(spark, monkeypatch):
    """Sets of a tile beyond the bytes of a part: the same links, from several parts."""
    texts = edited(150, 300, 3)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = expected(texts, 85, range(len(texts)))
    monkeypatch.setattr(minhash, "TILE_BYTES", 40_000)
    monkeypatch.setattr(minhash, "FEW_IDS", 0)
    assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(frame, 85).collect()} == set(enumerate(want))
