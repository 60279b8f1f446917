"""Derived fixtures (see FIXTURES.md section 3), as Spark jobs and as SQL.

Each ``f_*`` builds a DataFrame from the given tables; ``SQL_*`` holds the
DuckDB common table expression that defines the same rows for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators.pooling import pool_mean
from ..session import load
from .indexing import row_index
from .joins import broadcast_if_small

# Fixed values of the reference configuration: begin, pad and end ids.
BOS_ID, PAD_ID, EOS_ID = 0, 1, 2
N_SPECIAL = 3


def ranked_docs(spark: SparkSession, d: str) -> DataFrame:
    """documents with rk = rank by doc_id within (source, lang), skew-safe."""
    docs = load(spark, d, "documents").select("doc_id", "text", "lang", "source")
    return row_index(docs, ["doc_id"], partition_by=["source", "lang"], name="rk")


def f_pairs(spark: SparkSession, d: str) -> DataFrame:
    r = ranked_docs(spark, d)
    en = r.filter(F.col("lang") == "en").select("source", "rk", F.col("text").alias("source_text"))
    other = r.filter(F.col("lang") != "en").select(
        "source", "rk", F.col("doc_id").alias("id"), F.col("text").alias("target_text"), "lang")
    return other.join(en, ["source", "rk"]).select("id", "source_text", "target_text", "lang")


SQL_RANKED = """ranked AS (
  SELECT doc_id, text, lang, source,
         row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS rk
  FROM documents)"""

SQL_PAIRS = SQL_RANKED + """,
f_pairs AS (
  SELECT t.doc_id AS id, e.text AS source_text, t.text AS target_text, t.lang AS lang
  FROM ranked t JOIN ranked e ON e.source = t.source AND e.rk = t.rk AND e.lang = 'en'
  WHERE t.lang <> 'en')"""

CAPTION_LANGS = ["en", "fr", "de", "es"]


def f_captions(spark: SparkSession, d: str) -> DataFrame:
    """One row per (source, rank): id = smallest doc_id, a column per language."""
    r = ranked_docs(spark, d)
    return (r.groupBy("source", "rk")
             .agg(F.min("doc_id").alias("id"),
                  *[F.max(F.when(F.col("lang") == l, F.col("text"))).alias(l) for l in CAPTION_LANGS])
             .select("id", *CAPTION_LANGS))


SQL_CAPTIONS = SQL_RANKED + """,
f_captions AS (
  SELECT min(doc_id) AS id,
         max(CASE WHEN lang = 'en' THEN text END) AS en,
         max(CASE WHEN lang = 'fr' THEN text END) AS fr,
         max(CASE WHEN lang = 'de' THEN text END) AS de,
         max(CASE WHEN lang = 'es' THEN text END) AS es
  FROM ranked GROUP BY source, rk)"""


def mean_vectors(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Per key: element-wise mean of the vectors (per-task sums, then their sum)."""
    rows = df.select(key, vec, F.lit(1.0).alias("_one"))
    return pool_mean(rows, key, vec, "_one").withColumnRenamed("pooled", "mean")


def f_classes(spark: SparkSession, d: str) -> DataFrame:
    emb = load(spark, d, "embeddings")
    m = mean_vectors(emb, "label", "embedding")
    return m.select(F.col("label").cast("int").alias("label"), V.l2_normalize("mean").alias("vector"))


SQL_CLASSES = """f_classes AS (
  SELECT label, list_transform(mean, lambda x: x / sqrt(list_sum(list_transform(mean, lambda y: y * y)))) AS vector
  FROM (SELECT label, list(x ORDER BY pos) AS mean
        FROM (SELECT label, pos, avg(x) AS x
              FROM (SELECT label, unnest(generate_series(1, len(embedding))) AS pos,
                           unnest(embedding::DOUBLE[]) AS x FROM embeddings)
              GROUP BY label, pos)
        GROUP BY label))"""


def f_teacher(spark: SparkSession, d: str) -> DataFrame:
    emb = load(spark, d, "embeddings")
    classes = f_classes(spark, d)
    width = emb.select(F.size("embedding")).first()  # bytes of a class vector, for the size check
    classes, _ = broadcast_if_small(classes, row_bytes=8 * (width[0] if width else 1) + 16, max_bytes=64 * 1024 * 1024)
    return (emb.join(classes, "label")
               .select("vec_id", F.col("embedding").alias("student"), F.col("vector").alias("teacher"), "label"))


SQL_TEACHER = SQL_CLASSES + """,
f_teacher AS (
  SELECT e.vec_id, e.embedding AS student, c.vector AS teacher, e.label
  FROM embeddings e JOIN f_classes c USING (label))"""


def f_imgtext(spark: SparkSession, d: str) -> DataFrame:
    emb = load(spark, d, "embeddings")
    t = emb.filter(F.col("vec_id") % 2 == 0).select(
        (F.col("vec_id") / 2).cast("long").alias("pair_id"), F.col("embedding").alias("text_vec"))
    i = emb.filter(F.col("vec_id") % 2 == 1).select(
        ((F.col("vec_id") - 1) / 2).cast("long").alias("pair_id"), F.col("embedding").alias("image_vec"))
    return t.join(i, "pair_id")


SQL_IMGTEXT = """f_imgtext AS (
  SELECT t.pair_id, t.text_vec, i.image_vec
  FROM (SELECT vec_id // 2 AS pair_id, embedding AS text_vec FROM embeddings WHERE vec_id % 2 = 0) t
  JOIN (SELECT vec_id // 2 AS pair_id, embedding AS image_vec FROM embeddings WHERE vec_id % 2 = 1) i
  USING (pair_id))"""


def f_seq(spark: SparkSession, d: str) -> DataFrame:
    emb = load(spark, d, "embeddings")
    r = row_index(emb, ["vec_id"], partition_by=["label"], name="rk", start=0)
    masked = F.col("vec_id") % 5 == 0
    return r.select(F.col("label").cast("long").alias("seq_id"),
                    F.col("rk").alias("pos"),
                    F.when(masked, F.lit(PAD_ID)).otherwise(F.col("vec_id") + N_SPECIAL).cast("long").alias("token"),
                    F.when(masked, 0).otherwise(1).alias("mask"),
                    F.col("embedding").alias("vec"))


SQL_SEQ = """f_seq AS (
  SELECT label::BIGINT AS seq_id,
         (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::BIGINT AS pos,
         (CASE WHEN vec_id % 5 = 0 THEN 1 ELSE vec_id + 3 END)::BIGINT AS token,
         CASE WHEN vec_id % 5 = 0 THEN 0 ELSE 1 END AS mask,
         embedding AS vec
  FROM embeddings)"""


def f_log(spark: SparkSession, d: str) -> DataFrame:
    ev = load(spark, d, "events")
    return ev.select(F.col("event_id").alias("step"),
                     F.when(F.col("event_type") == "error", F.lit(float("nan")))
                      .otherwise(F.col("value")).alias("loss"),
                     "ts")


SQL_LOG = """f_log AS (
  SELECT event_id AS step, CASE WHEN event_type = 'error' THEN 'NaN'::DOUBLE ELSE value END AS loss, ts
  FROM events)"""


def f_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).select(
        "doc_id", (F.col("p") + 1).cast("long").alias("line_no"), "line")


SQL_LINES = """f_lines AS (
  SELECT doc_id, generate_subscripts(parts, 1)::BIGINT AS line_no, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))"""
