"""Tiny tables with values worked out by hand."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pairloom.functions import vectors as V
from pairloom.operators import metrics as M
from pairloom.operators import pooling as PL
from pairloom.operators import similarity as S


def test_cosine_loss_and_mse(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0])], "x array<float>, y array<float>")
    r = df.agg(M.cosine_loss("x", "y").alias("cl"), M.mse("x", "y").alias("mse"), M.l1("x", "y").alias("l1")).first()
    assert math.isclose(r.cl, 0.5) and math.isclose(r.mse, 0.5) and math.isclose(r.l1, 0.5)


def test_contrastive_loss_two_by_two(spark):
    # unit vectors e1, e2 against themselves, scale 1: loss = log(e + 1) - 1 for each row
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "id long, v array<double>")
    got = S.contrastive_loss(df, df, q_id="id", q_vec="v", c_id="id", c_vec="v", scale=1.0).first().loss
    assert math.isclose(got, math.log(math.e + 1) - 1, rel_tol=1e-12)


def test_eval_loss_weights_short_batch(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 10.0)], "b long, loss double")
    r = M.eval_loss(df, "b", "loss").first()
    assert math.isclose(r.eval_loss, (2.0 * 2 + 10.0 * 1) / 3) and r.n_batches == 2


def test_interval_loss_with_nan(spark):
    # interval of 3 steps: 2.0, NaN, 4.0 -> S = (2 * (1 + 1/2)) + 4 = 7 -> 7/3
    df = spark.createDataFrame([(0, 2.0), (1, float("nan")), (2, 4.0), (3, 1.0)], "step long, loss double")
    rows = {r.interval: r.loss for r in M.interval_loss(df, "step", "loss", 3).collect()}
    assert math.isclose(rows[0], 7.0 / 3) and math.isclose(rows[1], 1.0)
    assert math.isclose(rows[-1], (7.0 + 1.0) / 4)


def test_position_ids(spark):
    df = spark.createDataFrame([(0, 0, 5), (0, 1, 1), (0, 2, 9), (0, 3, 1)], "seq long, pos long, tok long")
    got = {r.pos: r.position_id for r in PL.position_ids(df, "seq", "pos", "tok", pad_id=1).collect()}
    assert got == {0: 2, 1: 1, 2: 3, 3: 1}
    arr = spark.createDataFrame([([5, 1, 9, 1],)], "ids array<long>")
    assert arr.select(PL.position_ids_array("ids", 1).alias("p")).first().p == [2, 1, 3, 1]


def test_l2_normalize_zero_vector_is_null(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    out = [r.u for r in df.select(V.l2_normalize("v").alias("u")).collect()]
    assert out[0] == [0.6, 0.8] and out[1] is None


def test_argmax_first_of_ties(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "v array<double>")
    assert df.select(V.argmax("v").alias("a")).first().a == 1


def test_pool_max_uses_valid_positions(spark):
    df = spark.createDataFrame([(0, [1.0, 5.0], 1), (0, [9.0, 9.0], 0), (0, [2.0, 0.0], 1)],
                               "s long, v array<double>, m int")
    assert PL.pool_max(df, "s", "v", "m").first().pooled == [2.0, 5.0]
    assert PL.pool_mean(df, "s", "v", "m").first().pooled == [1.5, 2.5]


def test_density_histogram_area_is_one(spark):
    df = spark.range(1000).select((F.col("id") * 0.37).alias("x"))
    h = M.density_histogram(df, "x", 20).collect()
    width = h[0].hi - h[0].lo
    assert math.isclose(sum(r.density for r in h) * width, 1.0, rel_tol=1e-9)
    assert sum(r["count"] for r in h) == 1000
