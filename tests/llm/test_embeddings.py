"""Embedding near-duplicates against brute force, at the production settings too."""

import collections

import numpy as np
import pytest

from claimweave.llm import embeddings


def brute(x):
    """Links of the rows of x, and the least index that they reach."""
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = [np.flatnonzero(y @ y[k] >= 0.95) for k in range(len(y))]
    count, label = np.array([len(n) - 1 for n in near]), np.arange(len(y))
    while True:
        was = label.copy()
        label = np.array([label[n].min() for n in near])
        if (was == label).all():
            return count, label


def frame_of(spark, x, kind="array<float>"):
    return spark.createDataFrame([(k, v.tolist(), k % 3) for k, v in enumerate(x)], f"vec_id long, embedding {kind}, n_links int")


def test_small_table_with_odd_vectors(spark):
    g = np.random.default_rng(5)
    x = g.standard_normal((300, 24))
    x[100:180] = x[0] + 0.2 * g.standard_normal((80, 24))
    x[200:230] = x[50]
    x = np.float32(x)
    odd = [(300, None, 0), (301, [0.0] * 24, 0), (302, [float("nan")] + [1.0] * 23, 0), (303, [None] + [1.0] * 23, 0), (304, [], 0), (305, [1.0] * 7, 0)]
    frame = frame_of(spark, x).unionByName(spark.createDataFrame(odd, "vec_id long, embedding array<float>, n_links int"))
    count, label = brute(x.astype(float))
    got = {r.vec_id: r for r in embeddings.near_duplicates(frame, miss=1e-9).collect()}
    assert [got[k].n_links for k in range(300)] == count.tolist() and [got[k].component_id for k in range(300)] == label.tolist()
    assert all(got[k].n_links == 0 and got[k].kept and got[k].component_id == k for k in range(300, 306))
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


def test_recall_at_production_settings(spark):
    """24,000 vectors, among them pairs close to the threshold on both sides: links found, and none below it."""
    g = np.random.default_rng(9)
    x = g.standard_normal((24_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = g.standard_normal((4000, 64))
    side -= (side * x[:4000]).sum(axis=1, keepdims=True) * x[:4000]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = np.linspace(0.94, 0.97, 4000)[:, None]
    x[4000:8000] = cosine * x[:4000] + np.sqrt(1 - cosine**2) * side
    assert embeddings.tables(len(x), 0.95)[1] > 1
    want, _ = brute(x)
    got = np.array([r.n_links for r in embeddings.near_duplicates(frame_of(spark, x, "array<double>")).orderBy("vec_id").select("n_links").collect()])
    assert (got <= want).all() and got.sum() >= 0.999 * want.sum()


def test_long_keys(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 1)  # ten bits and more, and hundreds of tiles for each bucket
    x = np.random.default_rng(3).standard_normal((2000, 16))
    x[1000:1500] = x[:500] + 0.05 * np.random.default_rng(4).standard_normal((500, 16))
    bits, n_tables = embeddings.tables(2000, 0.95)
    assert bits >= 10 and n_tables > 20
    want, label = brute(x)
    rows = embeddings.near_duplicates(frame_of(spark, x, "array<double>")).orderBy("vec_id").collect()
    assert sum(r.n_links for r in rows) >= 0.999 * want.sum() and np.mean([r.component_id for r in rows] == label) > 0.999
    assert embeddings.width(16) == "<u2" and embeddings.width(17) == "<u4"


def test_tiles_split_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    monkeypatch.setattr(embeddings, "MOST_BITS", 4)
    g = np.random.default_rng(6)
    x = g.standard_normal(16) + 0.01 * g.standard_normal((120, 16))
    assert {(r.n_links, r.component_id) for r in embeddings.near_duplicates(frame_of(spark, x, "array<double>")).collect()} == {(119, 0)}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_repeated_and_missing_ids_are_vectors_of_their_own(spark, kind):
    e = np.eye(8)
    close = lambda k: (e[k] + 0.01 * e[7]).tolist()
    rows = [(1, e[0].tolist()), (1, e[1].tolist()), (2, close(0)), (3, close(1)), (4, e[2].tolist()), (4, e[2].tolist()), (None, e[3].tolist()), (5, close(3)), (None, e[4].tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr(f"cast(vec_id as {kind}) vec_id", "embedding")
    as_ = (lambda v: v) if kind == "long" else (lambda v: None if v is None else str(v))
    got = collections.Counter(map(tuple, embeddings.near_duplicates(frame, miss=1e-9).select("vec_id", "n_links", "component_id").collect()))
    want = [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 4), (4, 1, 4), (None, 1, 5), (5, 1, 5), (None, 0, None)]
    assert got == collections.Counter((as_(a), n, as_(b)) for a, n, b in want)


def test_bounds_hold():
    g = np.random.default_rng(1)
    x = embeddings.unit(np.repeat(g.standard_normal((20, 32)), 6, axis=0) + 0.22 * g.standard_normal((120, 32)))
    code, scale, error = embeddings.quantised(x)
    assert np.abs(code).max() <= 127 and (np.linalg.norm(x - code * scale[:, None].astype(float), axis=1) <= error).all()
    raw = [np.array([(k, 1, scale[k], error[k])], embeddings.HEAD).tobytes() + code[k].tobytes() for k in range(120)]
    i, j, sure = (np.concatenate(p) for p in zip(*embeddings.Tile(raw, np.zeros(120, int), 0, "<u2").pairs(0.95), strict=True))
    true = {(a, b) for a, b in zip(*np.nonzero(x @ x.T >= 0.95), strict=True) if a < b}
    assert {(a, b) for a, b, s in zip(i, j, sure, strict=True) if s} <= true <= set(zip(i, j, strict=True))
