"""Large batches in tiles, the linear map on a triangle, pooling as one sorted pass, tables published whole."""

import os
import threading

import numpy as np
import pytest

from pairloom.operators import pooling as PL
from pairloom.operators import similarity as S
from pairloom.operators import udf as U


def _batches(spark, n: int = 60):
    rng = np.random.default_rng(5)
    vec = [rng.integers(-2, 3, size=3).astype(float).tolist() for _ in range(3 * n)]  # few values: many equal scores
    rows = [(0 if i < n else 1 if i < n + 7 else None, i // 2, vec[i], vec[-i] if i % 5 else vec[i]) for i in range(n + 14)]
    return spark.createDataFrame([*rows, (0, 1000, None, vec[0]), (0, 1001, [0.0, 0.0, 0.0], vec[0])], "b long, id long, x array<double>, y array<double>")


@pytest.mark.parametrize("tile", [16, 59])
def test_batches_of_any_tile_size_give_the_same_rows(spark, tile):
    df = _batches(spark)

    def rows(size):
        out = S.in_batch_pairs(df, batch_col="b", id_col="id", a_vec="x", b_vec="y", tile_rows=size).collect()
        return sorted((r.batch_id is None, r.batch_id or 0, r.id, r["size"] or 0, round(r.diag, 9) if r.diag is not None else -1e9,
                       r["rank"] or 0, round(r.lse, 9) if r.lse is not None else -1e9) for r in out)

    assert rows(tile) == rows(10_000)


def test_batch_rows_against_plain_loops(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(2, 90, 4))
    df = spark.createDataFrame([(i // 45, i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b, strict=True))], "b long, id long, x array<double>, y array<double>")
    got = {r.id: r for r in S.in_batch_pairs(df, batch_col="b", id_col="id", a_vec="x", b_vec="y", scale=2.0, normalize=False, tile_rows=20).collect()}
    for i in range(90):
        scores = [2.0 * float(a[i] @ b[j]) for j in range(i // 45 * 45, i // 45 * 45 + 45)]
        own = scores[i % 45]
        assert got[i]["rank"] == 1 + sum(s > own for s in scores) and got[i]["size"] == 45
        assert np.isclose(got[i].lse, np.log(np.exp(scores).sum())) and np.isclose(got[i].diag, own)


def test_linear_map_where_normal_equations_fail(spark):
    rng = np.random.default_rng(7)
    u, v = np.linalg.qr(rng.normal(size=(400, 6)))[0], np.linalg.qr(rng.normal(size=(6, 6)))[0]
    x = u @ np.diag(np.logspace(0, -10, 6)) @ v  # condition 1e10; that of X^T X is beyond double precision
    w = rng.normal(size=(6, 2))
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, x @ w, strict=True)], "x array<double>, y array<double>").repartition(5)
    got = np.zeros((6, 2))
    for r in S.fit_linear_map(df, "x", "y").collect():
        got[r.i, r.j] = r.w
    assert np.abs(got - w).max() < 1e-3
    assert np.abs(np.linalg.solve(x.T @ x, x.T @ (x @ w)) - w).max() > 1e-2


def test_linear_map_at_its_edges(spark, monkeypatch):
    schema = "x array<double>, y array<double>"
    none = spark.createDataFrame([], schema)
    assert S.fit_linear_map(none, "x", "y").count() == 0 and S.gram_sums(none, "x", "y").count() == 0
    lone = spark.createDataFrame([([2.0, 0.0], [6.0]), (None, [1.0]), ([1.0, 1.0], None)], schema)  # fewer rows than columns
    assert {(r.i, r.j): round(r.w, 9) for r in S.fit_linear_map(lone, "x", "y").collect()} == {(0, 0): 3.0, (1, 0): 0.0}
    assert {(r.i, r.j): round(r.w, 9) for r in S.fit_linear_map(lone, "x", "y", ridge=4.0).collect()} == {(0, 0): 1.5, (1, 0): 0.0}
    monkeypatch.setattr(S, "QR_ROWS", 4)  # many reductions within a task
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(50, 3)), rng.normal(size=(50, 2))
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y, strict=True)], schema)
    got = {(r.kind, r.i, r.j): r.v for r in S.gram_sums(df, "x", "y").collect()}
    for kind, m in (("xtx", x.T @ x), ("xty", x.T @ y)):
        assert all(np.isclose(got[kind, i, j], m[i, j]) for i in range(3) for j in range(m.shape[1]))
    assert len(got) == 15


def test_pooling_is_one_sorted_pass(spark):
    rng = np.random.default_rng(9)
    data = [(f"s{int(i)}" if i else None, rng.normal(size=2).tolist(), int(rng.integers(0, 2))) for i in rng.integers(0, 200, size=3000)]
    data += [("hot", [float(i), -float(i)], 1) for i in range(2000)]
    df = spark.createDataFrame(data, "s string, v array<double>, m int").repartition(7)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")  # runs that cross batches
    try:
        mean, most = ({r.s: r.pooled for r in f(df, "s", "v", "m").collect()} for f in (PL.pool_mean, PL.pool_max))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for s in {d[0] for d in data}:
        real = np.array([v for k, v, m in data if k == s and m == 1]).reshape(-1, 2)
        assert (mean[s] is None and s not in most) if not len(real) else (np.allclose(mean[s], real.mean(axis=0)) and np.allclose(most[s], real.max(axis=0)))
    assert "FlatMapGroupsInPandas" not in PL.pool_mean(df, "s", "v", "m")._jdf.queryExecution().toString()


def test_a_table_is_published_whole(spark, tmp_path):
    path = tmp_path / "k"
    path.mkdir()
    (path / "part-left.parquet").write_bytes(b"half a table")  # an older job stopped here, without its mark
    barrier = threading.Barrier(2)

    def make():
        barrier.wait(60)  # both writers found nothing stored
        return spark.range(1000)

    counts = []
    writers = [threading.Thread(target=lambda: counts.append(U.materialize(make, spark, str(tmp_path), "k").count())) for _ in range(2)]
    for t in writers:
        t.start()
    for t in writers:
        t.join(120)
    assert counts == [1000, 1000] and spark.read.parquet(str(path)).count() == 1000
    assert os.listdir(tmp_path) == ["k"]
    assert U.materialize(lambda: spark.range(3), spark, str(tmp_path), "k", overwrite_cache=True).count() == 3
    assert os.listdir(tmp_path) == ["k"] and not [f for f in os.listdir(path) if f.startswith("_staged")]
