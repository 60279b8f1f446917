"""Checked queries: sources and sinks (S1-S12, P6). Each writes its input from the given tables
into a fresh folder below the shared checkpoint folder, then reads it back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..operators import metrics as M
from ..operators import pairs as PR
from ..operators import udf as U
from ..session import load, scratch_path
from ..sources import readers as RD
from ..sources import writers as WR
from . import fixtures as fx
from .q_pairs import SQL_HASHED
from .q_text import SQL_FTOKENS, f_tokens
from .registry import register


@register("read_pairs", f"WITH {fx.SQL_PAIRS} SELECT id, source_text, target_text, lang FROM f_pairs")
def q_read_pairs(spark, d):
    out = scratch_path(spark, "pairs-json")
    fx.f_pairs(spark, d).repartition(4).write.mode("overwrite").json(out)
    return RD.read_pairs(spark, f"{out}/part-*.json")


@register("read_splits", f"""WITH {fx.SQL_PAIRS},
s AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY md5(id::VARCHAR || ':42'), id) <= 100
                     THEN 'validation' ELSE 'train' END AS split FROM f_pairs)
SELECT split, count(*) AS n, sum(length(source_text) + length(target_text))::BIGINT AS chars FROM s GROUP BY split""")
def q_read_splits(spark, d):
    base = scratch_path(spark, "splits")
    sp = PR.exact_split(fx.f_pairs(spark, d), "id", 100, 42)
    sp.filter(F.col("split") == "train").drop("split").write.mode("overwrite").json(f"{base}/train.json")
    (sp.filter(F.col("split") == "validation").drop("split").write.mode("overwrite")
       .option("header", "true").option("escape", '"').csv(f"{base}/validation.csv"))
    df = RD.read_splits(spark, {"train": f"{base}/train.json", "validation": f"{base}/validation.csv"}, multi_line=True)
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"),
                                   F.sum(F.length("source_text") + F.length("target_text")).alias("chars"))


@register("read_records", """SELECT doc_id, lang, source, length(text)::BIGINT AS n_chars, md5(text) AS digest,
  (length(text) - length(replace(text, chr(10), '')))::BIGINT AS n_line_ends FROM documents""")
def q_read_records(spark, d):
    """Documents as CSV with line ends in their texts, cut into records by many tasks."""
    base = scratch_path(spark, "records") + "/all.csv"
    docs = load(spark, d, "documents").select("doc_id", "lang", "source", "text")
    (docs.write.mode("overwrite").option("header", "true").option("escape", '"').option("ignoreLeadingWhiteSpace", "false")
         .option("ignoreTrailingWhiteSpace", "false").csv(base))
    df = RD.read_splits(spark, {"all": base}, schema=docs.schema, multi_line=True)
    text = F.coalesce("text", F.lit(""))
    return df.select("doc_id", "lang", "source", F.length(text).cast("long").alias("n_chars"), F.md5(text).alias("digest"),
                     (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long").alias("n_line_ends"))


@register("read_prepared", f"WITH {fx.SQL_CAPTIONS} SELECT id, en, fr, de, es FROM f_captions")
def q_read_prepared(spark, d):
    out = scratch_path(spark, "prepared")
    WR.write_prepared(fx.f_captions(spark, d), out)
    return RD.read_prepared(spark, out)


@register("read_table", "SELECT doc_id, lang, source FROM documents")
def q_read_table(spark, d):
    load(spark, d, "documents").createOrReplaceTempView("pl_documents")
    return RD.read_table(spark, "pl_documents").select("doc_id", "lang", "source")


def _line_files(spark, d):
    """Text files of many documents, one after another; each line begins with its document's id and a tab.

    A line's number in its document is its number in the file less those of the lines before the document.
    """
    out = scratch_path(spark, "lines")
    docs = load(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    mark = F.concat(F.col("doc_id").cast("string"), F.lit("\t"))
    lined = F.concat(mark, F.replace("text", F.lit("\n"), F.concat(F.lit("\n"), mark)))
    docs.repartition("doc_id").sortWithinPartitions("doc_id").select(lined.alias("value")).write.mode("overwrite").text(out)
    tab = F.instr("line", "\t")
    lines = RD.read_lines(spark, out).select("path", "line_no", F.substring("line", F.lit(1), tab - 1).cast("long").alias("doc_id"),
                                             F.substring("line", tab + 1, F.length("line")).alias("line"))
    before = F.min("line_no").over(Window.partitionBy("path", "doc_id")) - 1
    return lines.select("doc_id", (F.col("line_no") - before).alias("line_no"), "line")


@register("read_lines", f"WITH {fx.SQL_LINES} SELECT doc_id, line_no, line FROM f_lines")
def q_read_lines(spark, d):
    return _line_files(spark, d)


@register("line_at", f"WITH {fx.SQL_LINES} SELECT doc_id, line FROM f_lines WHERE line_no = 2")
def q_line_at(spark, d):
    return RD.line_at(_line_files(spark, d), 2).select("doc_id", "line")


def f_files(spark, d):
    """F-files: pages.html, one file per page under a folder named by the sha256 of the html;
    pages with id mod 5 = 0 get a PNG header, = 1 a JPEG header (their checksum then fails)."""
    out = scratch_path(spark, "files")
    pages = load(spark, d, "pages")
    body = F.encode("html", "UTF-8")
    header = (F.when(F.col("page_id") % 5 == 0, F.unhex(F.lit(RD.IMAGE_MAGIC["png"])))
               .when(F.col("page_id") % 5 == 1, F.unhex(F.lit(RD.IMAGE_MAGIC["jpeg"])))
               .otherwise(F.unhex(F.lit(""))))
    files = pages.select(F.concat(F.sha2(body, 256), F.lit("/"), F.col("page_id").cast("string"), F.lit(".bin")).alias("name"),
                         F.concat(header, body).alias("content"))
    WR.write_files(files, out, "name", "content").count()
    media = RD.read_media(spark, out, glob="*.bin")
    return media.withColumn("page_id", F.regexp_extract("path", r"/(\d+)\.bin$", 1).cast("long"))


@register("read_media", f"""
SELECT page_id, octet_length(content) AS length, sha256(content) AS content_sha256 FROM (
  SELECT page_id, unhex(CASE page_id % 5 WHEN 0 THEN '{RD.IMAGE_MAGIC["png"]}' WHEN 1 THEN '{RD.IMAGE_MAGIC["jpeg"]}' ELSE '' END) || encode(html) AS content
  FROM pages)""")
def q_read_media(spark, d):
    return f_files(spark, d).select("page_id", "length", F.sha2("content", 256).alias("content_sha256"))


@register("drop_unreadable", "SELECT page_id FROM pages WHERE page_id % 5 IN (0, 1)")
def q_drop_unreadable(spark, d):
    return RD.drop_unreadable(f_files(spark, d)).select("page_id")


@register("drop_unparsable_json", "SELECT event_id FROM events WHERE json_valid(props)")
def q_drop_unparsable_json(spark, d):
    return RD.drop_unparsable_json(load(spark, d, "events").select("event_id", "props"), "props").select("event_id")


@register("verify_checksums", "SELECT page_id, page_id % 5 NOT IN (0, 1) AS checksum_ok FROM pages")
def q_verify_checksums(spark, d):
    return RD.verify_checksums(f_files(spark, d)).select("page_id", "checksum_ok")


@register("write_prepared", f"WITH {SQL_FTOKENS} SELECT doc_id, ids FROM f_tokens")
def q_write_prepared(spark, d):
    out = scratch_path(spark, "tokens")
    WR.write_prepared(f_tokens(spark, d), out)
    return spark.read.parquet(out)


@register("write_embeddings", f"""WITH {SQL_HASHED}
SELECT h.doc_id, d.source AS name, h.embedding FROM hashed h JOIN documents d USING (doc_id)""")
def q_write_embeddings(spark, d):
    out = scratch_path(spark, "embeddings")
    docs = load(spark, d, "documents")
    emb = U.embed_corpus(docs, "doc_id", "text").join(
        docs.select("doc_id", F.concat("source", F.lit(".json")).alias("file")), "doc_id")
    WR.write_embeddings(emb, out, "doc_id", "embedding", file_col="file")
    back = spark.read.parquet(out)
    return back.select("doc_id", "name", V.vec_round("embedding").alias("embedding"))


_ROWVEC_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()),
                               T.StructField("source", T.StringType()),
                               T.StructField("embedding", T.ArrayType(T.DoubleType()))])


@register("write_rows_with_vectors", f"""WITH {SQL_HASHED}
SELECT d.doc_id, d.lang, d.source, h.embedding FROM documents d JOIN hashed h USING (doc_id)""")
def q_write_rows_with_vectors(spark, d):
    out = scratch_path(spark, "rows-vectors")
    docs = load(spark, d, "documents")
    WR.write_rows_with_vectors(docs.select("doc_id", "lang", "source"),
                               U.embed_corpus(docs, "doc_id", "text"), out, "doc_id")
    back = spark.read.schema(_ROWVEC_SCHEMA).json(out)
    return back.select("doc_id", "lang", "source", V.vec_round("embedding").alias("embedding"))


_M = ("list_sum(list_transform(student::DOUBLE[], lambda x, i: (x - teacher[i]) * (x - teacher[i])))",
      "list_cosine_similarity(student::DOUBLE[], teacher)",
      "list_sum(list_transform(student::DOUBLE[], lambda x, i: abs(x - teacher[i])))")


def _report_sql(split: str, cond: str) -> str:
    sq, cos, ab = _M
    return f"""SELECT 'r1' AS run, '{split}' AS split, unnest(['{split}_mse', '{split}_cosine', '{split}_cosine_loss', '{split}_l1']) AS name,
  unnest([round(sum({sq}) / sum(len(student)), 4) + 0.0, round(avg({cos}), 4) + 0.0, round(avg(1 - {cos}), 4) + 0.0,
          round(sum({ab}) / sum(len(student)), 4) + 0.0]) AS value
FROM f_teacher WHERE {cond}"""


@register("write_metrics", f"""WITH {fx.SQL_TEACHER}
{_report_sql('validation', 'label < 5')}
UNION ALL
{_report_sql('test', 'label >= 5')}""")
def q_write_metrics(spark, d):
    out = scratch_path(spark, "metrics")
    t = fx.f_teacher(spark, d)
    for split, cond in [("validation", F.col("label") < 5), ("test", F.col("label") >= 5)]:
        WR.write_metrics(M.eval_report(t.filter(cond), "student", "teacher", prefix=split), out, "r1", split)
    schema = "run string, split string, name string, value double"
    return spark.read.schema(schema).json(out)


@register("write_text", "SELECT trim(url) AS value FROM pages")
def q_write_text(spark, d):
    out = scratch_path(spark, "text")
    WR.write_text(load(spark, d, "pages"), "url", out)
    return spark.read.text(out)
