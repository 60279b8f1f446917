"""Checked queries: vector functions, similarity, retrieval, losses (X12-X16, X18, X20, J2, J3, J5,
W1, W2, A5, A6, A15, A16, A18, A19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import batching as BT
from ..operators import similarity as S
from ..operators.pruned import top_k_pruned
from ..session import load
from . import fixtures as fx
from .indexing import row_index
from .registry import register

R = V.num_round
SCALE = 100.0  # logit scale used in the zero-shot guide

# Image channel mean and std of the reference preprocessing.
IMAGE_MEAN = [0.48145466, 0.4578275, 0.40821073]
IMAGE_STD = [0.26862954, 0.26130258, 0.27577711]
# Fixed value: default log logit scale of the reference configuration.
LOG_SCALE_DEFAULT = 2.6592


def _sim_sql(direction_pairs: list[tuple[str, str, str]], scale: float) -> str:
    parts = []
    for name, qv, cv in direction_pairs:
        parts.append(f"SELECT '{name}' AS direction, a.pair_id AS id, b.pair_id AS cid, "
                     f"{scale} * list_cosine_similarity(a.{qv}::DOUBLE[], b.{cv}::DOUBLE[]) AS score "
                     f"FROM f_imgtext a, f_imgtext b")
    return "s AS (" + " UNION ALL ".join(parts) + ")"


@register("similarity", f"""
WITH {fx.SQL_IMGTEXT},
{_sim_sql([("image_to_text", "image_vec", "text_vec"), ("text_to_image", "text_vec", "image_vec")], SCALE)},
m AS (SELECT direction, id, max(score) AS mx FROM s GROUP BY direction, id)
SELECT s.direction, s.id, first(s.cid ORDER BY s.score DESC, s.cid) AS best_id,
       round(max(s.score), 4) + 0.0 AS best_score,
       round(m.mx + ln(sum(exp(s.score - m.mx))), 4) + 0.0 AS lse
FROM s JOIN m USING (direction, id)
GROUP BY s.direction, s.id, m.mx
""")
def q_similarity(spark, d):
    out = S.similarity_both(fx.f_imgtext(spark, d), id_col="pair_id", a_vec="image_vec", b_vec="text_vec", scale=SCALE)
    direction = F.when(F.col("side") == 0, "image_to_text").otherwise("text_to_image")
    return out.select(direction.alias("direction"), F.col("q_id").alias("id"), "best_id",
                      R("best_score").alias("best_score"), R("lse").alias("lse"))


SQL_TOP_K = f"""
WITH {fx.SQL_IMGTEXT},
{_sim_sql([("text_to_image", "text_vec", "image_vec")], 1.0)},
r AS (SELECT id, cid, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, cid) AS rank FROM s)
SELECT id AS q_id, rank::BIGINT AS rank, cid AS c_id, round(score, 4) + 0.0 AS score FROM r WHERE rank <= 5
"""


@register("top_k", SQL_TOP_K)
def q_top_k(spark, d):
    p = fx.f_imgtext(spark, d)
    t = S.top_k(p, p, 5, q_id="pair_id", q_vec="text_vec", c_id="pair_id", c_vec="image_vec")
    return t.select("q_id", "rank", "c_id", R("score").alias("score"))


@register("top_k_pruned", SQL_TOP_K)
def q_top_k_pruned(spark, d):
    """The same rows from the blocks that the bounds do not rule out."""
    p = fx.f_imgtext(spark, d)
    t, _ = top_k_pruned(p, p, 5, q_id="pair_id", q_vec="text_vec", c_id="pair_id", c_vec="image_vec")
    return t.select("q_id", "rank", "c_id", R("score").alias("score"))


@register("softmax", f"""
WITH {fx.SQL_CLASSES},
s AS (SELECT e.vec_id, c.label, {SCALE} * list_cosine_similarity(e.embedding::DOUBLE[], c.vector) AS score
      FROM embeddings e, f_classes c),
z AS (SELECT s.vec_id, s.label, exp(s.score - mm.mx) AS e FROM s JOIN (SELECT vec_id, max(score) AS mx FROM s GROUP BY vec_id) mm USING (vec_id))
SELECT vec_id, list(label::BIGINT ORDER BY label) AS labels,
       list(round(e / tot, 4) + 0.0 ORDER BY label) AS probs
FROM (SELECT vec_id, label, e, sum(e) OVER (PARTITION BY vec_id) AS tot FROM z)
GROUP BY vec_id
""")
def q_softmax(spark, d):
    emb = load(spark, d, "embeddings")
    sm = S.softmax(emb, fx.f_classes(spark, d), q_id="vec_id", q_vec="embedding", c_id="label",
                   c_vec="vector", scale=SCALE)
    return sm.select(F.col("q_id").alias("vec_id"), F.col("c_ids").alias("labels"),
                     V.vec_round("probs").alias("probs"))


@register("nearest_entry", f"""
WITH {fx.SQL_CLASSES},
s AS (SELECT e.vec_id, c.label, list_dot_product(e.embedding::DOUBLE[], c.vector) AS score
      FROM embeddings e, f_classes c)
SELECT vec_id, first(label::BIGINT ORDER BY score DESC, label) AS nearest_id, round(max(score), 4) + 0.0 AS score
FROM s GROUP BY vec_id
""")
def q_nearest_entry(spark, d):
    emb = load(spark, d, "embeddings")
    n = S.nearest_entry(emb, fx.f_classes(spark, d), q_id="vec_id", q_vec="embedding", c_id="label",
                        c_vec="vector")
    return n.select(F.col("q_id").alias("vec_id"), "nearest_id", R("score").alias("score"))


@register("zero_shot_accuracy", f"""
WITH {fx.SQL_CLASSES},
s AS (SELECT e.vec_id, e.label AS truth, c.label,
             row_number() OVER (PARTITION BY e.vec_id
                                ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], c.vector) DESC, c.label) AS rank
      FROM embeddings e, f_classes c),
per AS (SELECT vec_id, max(CASE WHEN rank <= 1 AND label = truth THEN 1.0 ELSE 0.0 END) AS top1,
               max(CASE WHEN rank <= 5 AND label = truth THEN 1.0 ELSE 0.0 END) AS top5
        FROM s GROUP BY vec_id)
SELECT round(avg(top1), 4) + 0.0 AS top1, round(avg(top5), 4) + 0.0 AS top5 FROM per
""")
def q_zero_shot_accuracy(spark, d):
    emb = load(spark, d, "embeddings")
    acc = S.zero_shot_accuracy(emb, fx.f_classes(spark, d), id_col="vec_id", vec_col="embedding",
                               label_col="label", class_col="label", class_vec="vector")
    return acc.select(R("top1").alias("top1"), R("top5").alias("top5"))


def _recall_sql(src: str, fixture_sql: str, a: str, b: str, an: str, bn: str, id_col: str) -> str:
    return f"""
WITH {fixture_sql},
s AS (SELECT '{an}_to_{bn}' AS direction, x.{id_col} AS q, y.{id_col} AS c,
             list_cosine_similarity(x.{a}::DOUBLE[], y.{b}::DOUBLE[]) AS score FROM {src} x, {src} y
      UNION ALL
      SELECT '{bn}_to_{an}', x.{id_col}, y.{id_col},
             list_cosine_similarity(x.{b}::DOUBLE[], y.{a}::DOUBLE[]) FROM {src} x, {src} y),
t AS (SELECT direction, q, score AS ts FROM s WHERE q = c),
rk AS (SELECT s.direction, s.q,
              1 + count(*) FILTER (WHERE s.c <> s.q AND (s.score > t.ts OR (s.score = t.ts AND s.c < s.q))) AS rank
       FROM s JOIN t USING (direction, q) GROUP BY s.direction, s.q),
rec AS (SELECT direction || '_r' || k AS name, avg(CASE WHEN rank <= k THEN 1.0 ELSE 0.0 END) AS value
        FROM rk, (SELECT unnest([1, 5, 10]) AS k) GROUP BY direction, k)
SELECT name, round(value, 4) + 0.0 AS value FROM rec
UNION ALL SELECT 'mean_recall', round(avg(value), 4) + 0.0 FROM rec
"""


@register("recall_at_k", _recall_sql("f_imgtext", fx.SQL_IMGTEXT, "text_vec", "image_vec", "text", "image",
                                     "pair_id"))
def q_recall_at_k(spark, d):
    p = fx.f_imgtext(spark, d)
    r = S.retrieval_report(p, id_col="pair_id", a_vec="text_vec", b_vec="image_vec")
    return r.select("name", R("value").alias("value"))


@register("recall_at_k_teacher", _recall_sql("f_teacher", fx.SQL_TEACHER, "student", "teacher", "student",
                                             "teacher", "vec_id"))
def q_recall_at_k_teacher(spark, d):
    p = fx.f_teacher(spark, d)
    r = S.retrieval_report(p, id_col="vec_id", a_vec="student", b_vec="teacher", a_name="student",
                           b_name="teacher")
    return r.select("name", R("value").alias("value"))


BATCH, LARGE_BATCH = 32, 300


def _in_batch_sql(size):
    return f"""
WITH {fx.SQL_IMGTEXT},
b AS (SELECT pair_id, (row_number() OVER (ORDER BY pair_id) - 1) // {size} AS batch_id, image_vec, text_vec
      FROM f_imgtext),
s AS (SELECT x.batch_id, x.pair_id AS id, y.pair_id AS cid,
             {SCALE} * list_cosine_similarity(x.image_vec::DOUBLE[], y.text_vec::DOUBLE[]) AS score
      FROM b x JOIN b y USING (batch_id)),
m AS (SELECT id, max(score) AS mx FROM s GROUP BY id),
dg AS (SELECT id, score AS dg FROM s WHERE id = cid)
SELECT s.batch_id::BIGINT AS batch_id, s.id, round(m.mx + ln(sum(exp(s.score - m.mx))), 4) + 0.0 AS lse,
       round(dg.dg, 4) + 0.0 AS diag,
       (1 + count(*) FILTER (WHERE s.cid <> s.id AND (s.score > dg.dg OR (s.score = dg.dg AND s.cid < s.id))))::BIGINT AS rank,
       count(*)::BIGINT AS size
FROM s JOIN m USING (id) JOIN dg USING (id)
GROUP BY s.batch_id, s.id, m.mx, dg.dg
"""


@register("in_batch_pairs", _in_batch_sql(BATCH))
def q_in_batch_pairs(spark, d):
    return _in_batch(spark, d, BATCH)


@register("in_batch_pairs_tiled", _in_batch_sql(LARGE_BATCH))
def q_in_batch_pairs_tiled(spark, d):
    """Batches larger than a tile."""
    return _in_batch(spark, d, LARGE_BATCH, tile_rows=128)


def _in_batch(spark, d, size, **how):
    p = BT.batch_ids(fx.f_imgtext(spark, d), size, order_by=["pair_id"])
    r = S.in_batch_pairs(p, batch_col="batch_id", id_col="pair_id", a_vec="image_vec", b_vec="text_vec", scale=SCALE, **how)
    return r.select("batch_id", "id", R("lse").alias("lse"), R("diag").alias("diag"), "rank", "size")


_LOSS_SQL = f"""
{_sim_sql([("image_to_text", "image_vec", "text_vec"), ("text_to_image", "text_vec", "image_vec")], SCALE)},
m AS (SELECT direction, id, max(score) AS mx FROM s GROUP BY direction, id),
per AS (SELECT s.direction, s.id, m.mx + ln(sum(exp(s.score - m.mx))) - max(CASE WHEN s.cid = s.id THEN s.score END) AS l
        FROM s JOIN m USING (direction, id) GROUP BY s.direction, s.id, m.mx),
dl AS (SELECT direction, avg(l) AS loss FROM per GROUP BY direction)"""


@register("contrastive_loss", f"""
WITH {fx.SQL_IMGTEXT}, {_LOSS_SQL}
SELECT round(loss, 4) + 0.0 AS loss FROM dl WHERE direction = 'image_to_text'
""")
def q_contrastive_loss(spark, d):
    p = fx.f_imgtext(spark, d)
    out = S.contrastive_loss(p, p, q_id="pair_id", q_vec="image_vec", c_id="pair_id", c_vec="text_vec",
                             scale=SCALE)
    return out.select(R("loss").alias("loss"))


@register("contrastive_loss_sym", f"""
WITH {fx.SQL_IMGTEXT}, {_LOSS_SQL}
SELECT round(avg(loss), 4) + 0.0 AS loss,
       round(max(CASE WHEN direction = 'image_to_text' THEN loss END), 4) + 0.0 AS loss_a_to_b,
       round(max(CASE WHEN direction = 'text_to_image' THEN loss END), 4) + 0.0 AS loss_b_to_a
FROM dl
""")
def q_contrastive_loss_sym(spark, d):
    p = fx.f_imgtext(spark, d)
    out = S.contrastive_loss_sym(p, id_col="pair_id", a_vec="image_vec", b_vec="text_vec", scale=SCALE)
    return out.select(*[R(c).alias(c) for c in ["loss", "loss_a_to_b", "loss_b_to_a"]])


@register("masked_cross_entropy", f"""
WITH {fx.SQL_CLASSES}, {fx.SQL_SEQ},
t AS (SELECT seq_id, pos, CASE WHEN mask = 1 THEN seq_id ELSE -100 END AS lab, vec FROM f_seq),
s AS (SELECT t.seq_id, t.pos, t.lab, c.label, list_dot_product(t.vec::DOUBLE[], c.vector) AS logit
      FROM t, f_classes c WHERE t.lab <> -100),
per AS (SELECT seq_id, pos, max(logit) + ln(sum(exp(logit - mx))) - max(CASE WHEN label = lab THEN logit END) AS l
        FROM (SELECT *, max(logit) OVER (PARTITION BY seq_id, pos) AS mx FROM s) GROUP BY seq_id, pos, mx)
SELECT round(avg(l), 4) + 0.0 AS loss, count(*) AS n_tokens FROM per
""")
def q_masked_cross_entropy(spark, d):
    seq = fx.f_seq(spark, d)
    seq = row_index(seq, ["seq_id", "pos"], name="tok_id")  # a key of its own: no limit on positions
    toks = seq.select("tok_id", "vec",
                      F.when(F.col("mask") == 1, F.col("seq_id")).otherwise(F.lit(-100)).alias("lab"))
    out = S.masked_cross_entropy(toks, fx.f_classes(spark, d), id_col="tok_id", vec_col="vec", label_col="lab",
                                 class_col="label", class_vec="vector")
    return out.select(R("loss").alias("loss"), "n_tokens")


@register("project", f"""
WITH {fx.SQL_CLASSES}
SELECT e.vec_id, list(round(list_dot_product(e.embedding::DOUBLE[], c.vector), 4) + 0.0 ORDER BY c.label) AS projected
FROM embeddings e, f_classes c GROUP BY e.vec_id
""")
def q_project(spark, d):
    emb = load(spark, d, "embeddings")
    p = S.project(emb, fx.f_classes(spark, d), id_col="vec_id", vec_col="embedding", row_col="label",
                  row_vec="vector")
    return p.select("vec_id", V.vec_round("projected").alias("projected"))


@register("fit_linear_map", f"""
WITH {fx.SQL_TEACHER},
x AS (SELECT vec_id, unnest(generate_series(0, len(student) - 1)) AS i, unnest(student::DOUBLE[]) AS xv FROM f_teacher),
y AS (SELECT vec_id, unnest(generate_series(0, len(teacher) - 1)) AS j, unnest(teacher::DOUBLE[]) AS yv FROM f_teacher),
x2 AS (SELECT vec_id, i AS j, xv AS yv FROM x)
SELECT 'xtx' AS kind, x.i::BIGINT AS i, x2.j::BIGINT AS j, round(sum(x.xv * x2.yv), 4) + 0.0 AS v
FROM x JOIN x2 USING (vec_id) GROUP BY x.i, x2.j
UNION ALL
SELECT 'xty', x.i::BIGINT, y.j::BIGINT, round(sum(x.xv * y.yv), 4) + 0.0 FROM x JOIN y USING (vec_id) GROUP BY x.i, y.j
""")
def q_fit_linear_map(spark, d):
    g = S.gram_sums(fx.f_teacher(spark, d), "student", "teacher")
    return g.select("kind", "i", "j", R("v").alias("v"))


def _map_vectors(spark, d):
    """x = embedding, y = first four values of the embedding, one rotated into the other: an exact linear map."""
    emb = load(spark, d, "embeddings").select("vec_id", V.as_double("embedding").alias("x"))
    return emb.withColumn("y", F.array(F.col("x")[1] * 2.0, F.col("x")[0] - F.col("x")[2], F.col("x")[3], F.lit(0.5) * F.col("x")[0]))


@register("solve_linear_map", """
WITH d AS (SELECT unnest(generate_series(0, len(embedding) - 1)) AS i FROM (SELECT embedding FROM embeddings LIMIT 1))
SELECT i::BIGINT AS i, j::BIGINT AS j,
       CASE WHEN i = 1 AND j = 0 THEN 2.0 WHEN i = 0 AND j = 1 THEN 1.0 WHEN i = 2 AND j = 1 THEN -1.0
            WHEN i = 3 AND j = 2 THEN 1.0 WHEN i = 0 AND j = 3 THEN 0.5 ELSE 0.0 END::DOUBLE AS w
FROM d, (SELECT unnest(generate_series(0, 3)) AS j)
""")
def q_solve_linear_map(spark, d):
    return S.fit_linear_map(_map_vectors(spark, d), "x", "y").select("i", "j", R("w").alias("w"))


@register("apply_linear_map", """
SELECT vec_id, list_transform([e[2] * 2.0, e[1] - e[3], e[4], 0.5 * e[1]], lambda x: round(x, 4) + 0.0) AS projected
FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
""")
def q_apply_linear_map(spark, d):
    v = _map_vectors(spark, d)
    out = S.apply_map(v, S.fit_linear_map(v, "x", "y"), id_col="vec_id", vec_col="x")
    return out.select("vec_id", V.vec_round("projected").alias("projected"))


# ---- row functions -------------------------------------------------------

@register("l2_normalize", f"""
WITH {fx.SQL_IMGTEXT},
v AS (SELECT pair_id, list_transform(list_zip(text_vec::DOUBLE[], image_vec::DOUBLE[]), lambda p: p[1] + p[2]) AS s
      FROM f_imgtext)
SELECT pair_id, list_transform(s, lambda x: round(x / sqrt(list_sum(list_transform(s, lambda y: y * y))), 4) + 0.0) AS unit
FROM v
""")
def q_l2_normalize(spark, d):
    p = fx.f_imgtext(spark, d)
    s = F.zip_with(V.as_double("text_vec"), V.as_double("image_vec"), lambda a, b: a + b)
    return p.select("pair_id", V.vec_round(V.l2_normalize(s)).alias("unit"))


@register("dot_cosine", f"""
WITH {fx.SQL_IMGTEXT}
SELECT pair_id, round(list_dot_product(text_vec::DOUBLE[], image_vec::DOUBLE[]), 4) + 0.0 AS dot,
       round(list_cosine_similarity(text_vec::DOUBLE[], image_vec::DOUBLE[]), 4) + 0.0 AS cosine
FROM f_imgtext
""")
def q_dot_cosine(spark, d):
    p = fx.f_imgtext(spark, d)
    return p.select("pair_id", R(V.dot("text_vec", "image_vec")).alias("dot"),
                    R(V.cosine("text_vec", "image_vec")).alias("cosine"))


@register("scale_logits", f"""
WITH {fx.SQL_IMGTEXT}
SELECT pair_id, round(list_cosine_similarity(text_vec::DOUBLE[], image_vec::DOUBLE[]) * exp({LOG_SCALE_DEFAULT}), 4) + 0.0 AS logit
FROM f_imgtext
""")
def q_scale_logits(spark, d):
    p = fx.f_imgtext(spark, d)
    return p.select("pair_id", R(V.scale_logits(V.cosine("text_vec", "image_vec"), LOG_SCALE_DEFAULT)).alias("logit"))


@register("argmax", """
SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS argmax FROM embeddings
""")
def q_argmax(spark, d):
    emb = load(spark, d, "embeddings")
    return emb.select("vec_id", V.argmax("embedding").alias("argmax"))


@register("masked_fill", f"""
WITH {fx.SQL_SEQ}
SELECT seq_id, pos, list_transform(vec::DOUBLE[], lambda x, i: CASE WHEN mask = 0 OR x < 0 THEN -100.0
                                   ELSE round(x, 4) + 0.0 END) AS filled
FROM f_seq
""")
def q_masked_fill(spark, d):
    seq = fx.f_seq(spark, d)
    m = F.transform(V.as_double("vec"), lambda x: (F.col("mask") == 0) | (x < 0))
    return seq.select("seq_id", "pos", V.vec_round(V.masked_fill("vec", m, -100.0)).alias("filled"))


@register("standardize_channels", f"""
SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x, i:
         round(((x + 1.0) * 127.5 / 255.0 - [{", ".join(map(str, IMAGE_MEAN))}][((i - 1) % 3) + 1])
               / [{", ".join(map(str, IMAGE_STD))}][((i - 1) % 3) + 1], 4) + 0.0) AS pixels
FROM embeddings
""")
def q_standardize_channels(spark, d):
    emb = load(spark, d, "embeddings")
    px = F.transform(V.as_double("embedding"), lambda x: (x + 1.0) * 127.5)
    return emb.select("vec_id", V.vec_round(V.standardize_channels(px, IMAGE_MEAN, IMAGE_STD)).alias("pixels"))


def flagship(spark, d):
    """Zero-shot report: label centroids as classes, scaled cosine, softmax, top-5 per vector."""
    emb = load(spark, d, "embeddings")
    classes = fx.f_classes(spark, d)
    top = S.top_k_softmax(emb, classes, 5, q_id="vec_id", q_vec="embedding", c_id="label", c_vec="vector",
                          scale=SCALE)
    return top.select(F.col("q_id").alias("vec_id"), "rank", F.col("c_id").alias("label"), R("prob").alias("prob"))


@register("zero_shot_top5", f"""
WITH {fx.SQL_CLASSES},
s AS (SELECT e.vec_id, c.label, {SCALE} * list_cosine_similarity(e.embedding::DOUBLE[], c.vector) AS score
      FROM embeddings e, f_classes c),
z AS (SELECT vec_id, label, score, max(score) OVER (PARTITION BY vec_id) AS mx FROM s),
p AS (SELECT vec_id, label, score, exp(score - mx) / sum(exp(score - mx)) OVER (PARTITION BY vec_id) AS prob,
             row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS rank FROM z)
SELECT vec_id, rank::BIGINT AS rank, label::BIGINT AS label, round(prob, 4) + 0.0 AS prob FROM p WHERE rank <= 5
""")
def q_zero_shot_top5(spark, d):
    return flagship(spark, d)

