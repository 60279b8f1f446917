"""Checked queries: metrics (A1-A4, A7-A10, A17, A20, A21), J1, pooling (A11-A14) and W3."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import batching as BT
from ..operators import metrics as M
from ..operators import pooling as PL
from ..session import load
from . import fixtures as fx
from .registry import register

R = V.num_round

_SQ = "list_sum(list_transform(student::DOUBLE[], lambda x, i: (x - teacher[i]) * (x - teacher[i])))"
_AB = "list_sum(list_transform(student::DOUBLE[], lambda x, i: abs(x - teacher[i])))"
_COS = "list_cosine_similarity(student::DOUBLE[], teacher)"


@register("mse", f"WITH {fx.SQL_TEACHER} SELECT round(sum({_SQ}) / sum(len(student)), 4) + 0.0 AS mse FROM f_teacher")
def q_mse(spark, d):
    return fx.f_teacher(spark, d).agg(R(M.mse("student", "teacher")).alias("mse"))


@register("mean_cosine", f"WITH {fx.SQL_TEACHER} SELECT round(avg({_COS}), 4) + 0.0 AS mean_cosine FROM f_teacher")
def q_mean_cosine(spark, d):
    return fx.f_teacher(spark, d).agg(R(M.mean_cosine("student", "teacher")).alias("mean_cosine"))


@register("cosine_loss", f"WITH {fx.SQL_TEACHER} SELECT round(avg(1 - {_COS}), 4) + 0.0 AS cosine_loss FROM f_teacher")
def q_cosine_loss(spark, d):
    return fx.f_teacher(spark, d).agg(R(M.cosine_loss("student", "teacher")).alias("cosine_loss"))


@register("l1", f"WITH {fx.SQL_TEACHER} SELECT round(sum({_AB}) / sum(len(student)), 4) + 0.0 AS l1 FROM f_teacher")
def q_l1(spark, d):
    return fx.f_teacher(spark, d).agg(R(M.l1("student", "teacher")).alias("l1"))


@register("eval_report", f"""
WITH {fx.SQL_TEACHER},
a AS (SELECT sum({_SQ}) / sum(len(student)) AS mse, avg({_COS}) AS cosine, avg(1 - {_COS}) AS cosine_loss,
             sum({_AB}) / sum(len(student)) AS l1 FROM f_teacher)
SELECT 'eval_mse' AS name, round(mse, 4) + 0.0 AS value FROM a
UNION ALL SELECT 'eval_cosine', round(cosine, 4) + 0.0 FROM a
UNION ALL SELECT 'eval_cosine_loss', round(cosine_loss, 4) + 0.0 FROM a
UNION ALL SELECT 'eval_l1', round(l1, 4) + 0.0 FROM a
""")
def q_eval_report(spark, d):
    return M.eval_report(fx.f_teacher(spark, d), "student", "teacher", prefix="eval")


@register("align_pairs", f"""
WITH {fx.SQL_TEACHER}
SELECT e.vec_id, list_transform(e.embedding::DOUBLE[], lambda x: round(x, 4) + 0.0) AS student,
       list_transform(t.teacher, lambda x: round(x, 4) + 0.0) AS teacher
FROM embeddings e JOIN f_teacher t USING (vec_id)
""")
def q_align_pairs(spark, d):
    student = load(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("student"))
    teacher = fx.f_teacher(spark, d).select("vec_id", "teacher")
    out = M.align_pairs(student, teacher, "vec_id")
    return out.select("vec_id", V.vec_round("student").alias("student"), V.vec_round("teacher").alias("teacher"))


@register("eval_loss", """
WITH b AS (SELECT value, (row_number() OVER (ORDER BY event_id) - 1) // 64 AS batch_id FROM events),
per AS (SELECT batch_id, avg(value) AS m, count(*) AS n FROM b GROUP BY batch_id)
SELECT round(sum(m * n) / sum(n), 4) + 0.0 AS eval_loss, count(*) AS n_batches, sum(n)::BIGINT AS n_rows FROM per
""")
def q_eval_loss(spark, d):
    ev = BT.batch_ids(load(spark, d, "events").select("event_id", "value"), 64, ["event_id"])
    out = M.eval_loss(ev, "batch_id", "value")
    return out.select(R("eval_loss").alias("eval_loss"), "n_batches", F.col("n_rows").cast("long").alias("n_rows"))


@register("interval_loss", f"""
WITH {fx.SQL_LOG},
p AS (SELECT step, loss, row_number() OVER (ORDER BY step) - 1 AS i FROM f_log),
q AS (SELECT i, i // 500 AS interval,
             CASE WHEN isnan(loss) OR isinf(loss) THEN 0.0 ELSE loss END AS x,
             CASE WHEN isnan(loss) OR isinf(loss) THEN ln(1 + 1 / (i - (i // 500) * 500 + 1)::DOUBLE) ELSE 0.0 END AS lnm
      FROM p),
r AS (SELECT interval, x, coalesce(sum(lnm) OVER (PARTITION BY interval ORDER BY i
                                                  ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0.0) AS after
      FROM q),
per AS (SELECT interval, sum(x * exp(after)) AS s, count(*) AS n_steps FROM r GROUP BY interval)
SELECT interval::BIGINT AS interval, n_steps, round(s / n_steps, 4) + 0.0 AS loss FROM per
UNION ALL SELECT -1, sum(n_steps)::BIGINT, round(sum(s) / sum(n_steps), 4) + 0.0 FROM per
""")
def q_interval_loss(spark, d):
    out = M.interval_loss(fx.f_log(spark, d), "step", "loss", 500)
    return out.select("interval", F.col("n_steps").cast("long").alias("n_steps"), R("loss").alias("loss"))


@register("sample_counts", """
SELECT lang, count(*) AS n_rows, least(count(*), 300)::BIGINT AS n_samples FROM documents GROUP BY lang
""")
def q_sample_counts(spark, d):
    return M.sample_counts(load(spark, d, "documents"), "lang", 300)


@register("density_histogram", """
WITH r AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS n, (max(value) - min(value)) / 200 AS w FROM events),
b AS (SELECT least(floor((e.value - r.lo) / r.w), 199)::BIGINT AS bin FROM events e, r WHERE e.value IS NOT NULL)
SELECT i.bin, count(b.bin) AS count, round(count(b.bin) / (r.n * r.w), 4) + 0.0 AS density,
       floor(r.lo + (i.bin + 0.5) * r.w) AS middle
FROM (SELECT unnest(generate_series(0, 199))::BIGINT AS bin) i LEFT JOIN b ON b.bin = i.bin, r GROUP BY i.bin, r.lo, r.w, r.n
""")
def q_density_histogram(spark, d):
    h = M.density_histogram(load(spark, d, "events"), "value", 200)
    # edges sit on decimal ties that the two engines round differently: the whole part of a bin's middle places it
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("double")
    return h.select("bin", "count", R("density").alias("density"), middle.alias("middle"))


@register("best_step", """
SELECT event_type, first(event_id ORDER BY value DESC, event_id) AS best_step, max(value) AS best_value
FROM events GROUP BY event_type
""")
def q_best_step(spark, d):
    return M.best_step(load(spark, d, "events"), "event_type", "event_id", "value", greater_is_better=True)


@register("best_step_min", """
SELECT event_type, first(event_id ORDER BY value, event_id) AS best_step, min(value) AS best_value
FROM events GROUP BY event_type
""")
def q_best_step_min(spark, d):
    return M.best_step(load(spark, d, "events"), "event_type", "event_id", "value", greater_is_better=False)


@register("speed_metrics", """
SELECT event_type, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 4) + 0.0 AS runtime, count(*) AS n_samples,
       round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 4) + 0.0 AS samples_per_second,
       ceil(count(*) / 64)::BIGINT AS steps
FROM events GROUP BY event_type
""")
def q_speed_metrics(spark, d):
    s = M.speed_metrics(load(spark, d, "events"), ["event_type"], "ts", 64)
    return s.select("event_type", R("runtime").alias("runtime"), "n_samples",
                    R("samples_per_second").alias("samples_per_second"), "steps")


# ---- pooling -------------------------------------------------------------

def _pool_sql(body: str) -> str:
    return f"""
WITH {fx.SQL_SEQ},
e AS (SELECT seq_id, mask, unnest(generate_series(0, len(vec) - 1)) AS dim, unnest(vec::DOUBLE[]) AS x FROM f_seq),
per AS ({body})
SELECT seq_id, list(round(v, 4) + 0.0 ORDER BY dim) AS pooled FROM per GROUP BY seq_id
"""


@register("pool_mean", _pool_sql("SELECT seq_id, dim, sum(x * mask) / sum(mask) AS v FROM e GROUP BY seq_id, dim"))
def q_pool_mean(spark, d):
    p = PL.pool_mean(fx.f_seq(spark, d), "seq_id", "vec", "mask")
    return p.select("seq_id", V.vec_round("pooled").alias("pooled"))


@register("pool_max", _pool_sql("SELECT seq_id, dim, max(x) AS v FROM e WHERE mask = 1 GROUP BY seq_id, dim"))
def q_pool_max(spark, d):
    p = PL.pool_max(fx.f_seq(spark, d), "seq_id", "vec", "mask")
    return p.select("seq_id", V.vec_round("pooled").alias("pooled"))


@register("pool_first", f"""
WITH {fx.SQL_SEQ}
SELECT seq_id, list_transform(vec::DOUBLE[], lambda x: round(x, 4) + 0.0) AS pooled FROM f_seq WHERE pos = 0
""")
def q_pool_first(spark, d):
    p = PL.pool_first(fx.f_seq(spark, d), "seq_id", "vec", "pos")
    return p.select("seq_id", V.vec_round("pooled").alias("pooled"))


@register("pool_eos", f"""
WITH {fx.SQL_SEQ}
SELECT seq_id, list_transform(first(vec ORDER BY token DESC, pos)::DOUBLE[], lambda x: round(x, 4) + 0.0) AS pooled
FROM f_seq GROUP BY seq_id
""")
def q_pool_eos(spark, d):
    p = PL.pool_eos(fx.f_seq(spark, d), "seq_id", "vec", "pos", "token")
    return p.select("seq_id", V.vec_round("pooled").alias("pooled"))


@register("pool_eos_id", f"""
WITH {fx.SQL_SEQ}
SELECT seq_id, list_transform(first(vec ORDER BY pos)::DOUBLE[], lambda x: round(x, 4) + 0.0) AS pooled
FROM f_seq WHERE token = 1 GROUP BY seq_id
""")
def q_pool_eos_id(spark, d):
    p = PL.pool_eos(fx.f_seq(spark, d), "seq_id", "vec", "pos", "token", eos_id=1)
    return p.select("seq_id", V.vec_round("pooled").alias("pooled"))


@register("position_ids", f"""
WITH {fx.SQL_SEQ}
SELECT seq_id, pos, (CASE WHEN token <> 1 THEN 1 + sum(CASE WHEN token <> 1 THEN 1 ELSE 0 END)
                          OVER (PARTITION BY seq_id ORDER BY pos ROWS UNBOUNDED PRECEDING)
                     ELSE 1 END)::BIGINT AS position_id
FROM f_seq
""")
def q_position_ids(spark, d):
    p = PL.position_ids(fx.f_seq(spark, d), "seq_id", "pos", "token", pad_id=fx.PAD_ID)
    return p.select("seq_id", "pos", "position_id")
