"""Pruned top-k against sorting all scores: on given vectors, planted clusters, ties and odd rows."""

from __future__ import annotations

import numpy as np

from pairloom.operators import pruned
from pairloom.session import load


def _brute(rows, ids, k):
    """[(q_id, rank, c_id)] by sorting all scores to 12 digits."""
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    good = [(i, unit(v)) for i, v in rows if v is not None and any(v)]
    out = []
    for i, v in good:
        score = sorted((-round(float(v @ w), 12), j) for j, w in good if j in ids)[:k]
        out += [(i, r, j) for r, (_, j) in enumerate(score, 1)]
    return sorted(out + [(i, None, None) for i, v in rows if v is None or not any(v)], key=str)


def _ids(df):
    return sorted(((r.q_id, r.rank, r.c_id) for r in df.collect()), key=str)


def _names(q="vec_id", c="vec_id"):
    return {"q_id": q, "q_vec": "embedding", "c_id": c, "c_vec": "embedding"}


def test_given_vectors(spark, small_dir):
    emb = load(spark, small_dir, "embeddings")
    got, share = pruned.top_k_pruned(emb, emb, 7, block_rows=16, per_pivot=20, **_names())
    rows = [(r.vec_id, r.embedding) for r in emb.collect()]
    assert _ids(got) == _brute(rows, {i for i, _ in rows}, 7) and 0 < share <= 1


def test_clusters_ties_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    vecs = [(centres[i % 40] + 0.05 * rng.normal(size=16)).tolist() for i in range(2000)]
    rows = [(i, v) for i, v in enumerate(vecs)] + [(3000 + i, vecs[0]) for i in range(300)] + [(5000, None), (5001, [0.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    got, share = pruned.top_k_pruned(df, df, 10, block_rows=32, scale=3.0, **_names())
    assert _ids(got) == _brute(rows, {i for i, _ in rows}, 10)
    assert share < 0.35, share
    few = df.where("vec_id < 4")
    got, _ = pruned.top_k_pruned(df, few, 10, **_names())
    assert _ids(got) == _brute(rows, {0, 1, 2, 3}, 10)


def test_no_candidates_and_no_queries(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    none, share = pruned.top_k_pruned(df, df.where("false"), 3, **_names())
    assert [tuple(r) for r in none.collect()] == [(1, None, None, None)] and share == 0
    assert pruned.top_k_pruned(df.where("false"), df, 3, **_names())[0].count() == 0
