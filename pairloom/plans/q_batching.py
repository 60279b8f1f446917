"""Checked queries: batches, shards, orders, resume, interleave."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batching as BT
from ..session import load
from .registry import register

# Fixed value: number of nodes the reference spreads input files over.
NODES = 18


def _docs(spark, d):
    return load(spark, d, "documents").select("doc_id", "lang", "source")


@register("batch_ids", """
SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 64)::BIGINT AS batch_id FROM documents
""")
def q_batch_ids(spark, d):
    return BT.batch_ids(_docs(spark, d), 64, ["doc_id"]).select("doc_id", "batch_id")


@register("batch_ids_drop_last", """
WITH b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
SELECT doc_id, (i // 64)::BIGINT AS batch_id FROM b WHERE i < (n // 64) * 64
""")
def q_batch_ids_drop_last(spark, d):
    return BT.batch_ids(_docs(spark, d), 64, ["doc_id"], drop_last=True).select("doc_id", "batch_id")


@register("contiguous_shards", f"""
WITH b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
SELECT doc_id, (i // ceil(n / {NODES})::BIGINT)::BIGINT AS shard FROM b
""")
def q_contiguous_shards(spark, d):
    return BT.contiguous_shards(_docs(spark, d), NODES, ["doc_id"]).select("doc_id", "shard")


@register("round_robin_shards", """
SELECT doc_id, (((row_number() OVER (ORDER BY doc_id) - 1) // 16) % 8)::BIGINT AS rank FROM documents
""")
def q_round_robin_shards(spark, d):
    return BT.round_robin_shards(_docs(spark, d), 16, 8, ["doc_id"]).select("doc_id", "rank")


_NAT_SQL = ("array_to_string(list_transform(regexp_extract_all(lower(source), '([0-9]+|[^0-9]+)'), lambda t: "
            "CASE WHEN regexp_matches(t, '^[0-9]') THEN lpad(length(ltrim(t, '0'))::VARCHAR, 10, '0') || ltrim(t, '0') ELSE t END), '')")


@register("natural_sort", f"""
SELECT source, row_number() OVER (ORDER BY {_NAT_SQL}, source) AS rank
FROM (SELECT DISTINCT source FROM documents)
""")
def q_natural_sort(spark, d):
    src = load(spark, d, "documents").select("source").distinct()
    return BT.natural_sort(src, "source").select("source", "rank")


@register("epoch_shuffle", """
SELECT doc_id, (row_number() OVER (ORDER BY md5(doc_id::VARCHAR || ':42:1'), doc_id) - 1)::BIGINT AS pos FROM documents
""")
def q_epoch_shuffle(spark, d):
    return BT.epoch_shuffle(_docs(spark, d), "doc_id", seed=42, epoch=1).select("doc_id", "pos")


@register("resume_after", """
WITH b AS (SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 16)::BIGINT AS batch_id FROM documents)
SELECT doc_id, batch_id, 2::BIGINT AS epoch FROM b WHERE batch_id >= (130 % 50) * 2
""")
def q_resume_after(spark, d):
    b = BT.batch_ids(_docs(spark, d), 16, ["doc_id"])
    return BT.resume_after(b, step=130, steps_per_epoch=50, accumulation=2).select("doc_id", "batch_id", "epoch")


@register("interleave", """
WITH m AS (SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 16)::BIGINT AS batch_id
           FROM documents WHERE lang = 'en'),
s AS (SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 16)::BIGINT AS batch_id
      FROM documents WHERE lang <> 'en'),
c AS (SELECT batch_id FROM m INTERSECT SELECT batch_id FROM s)
SELECT doc_id, batch_id, 0 AS which, batch_id * 2 AS step FROM m WHERE batch_id IN (SELECT batch_id FROM c)
UNION ALL
SELECT doc_id, batch_id, 1, batch_id * 2 + 1 FROM s WHERE batch_id IN (SELECT batch_id FROM c)
""")
def q_interleave(spark, d):
    docs = _docs(spark, d)
    m = BT.batch_ids(docs.filter(F.col("lang") == "en"), 16, ["doc_id"])
    s = BT.batch_ids(docs.filter(F.col("lang") != "en"), 16, ["doc_id"])
    return BT.interleave(m, s).select("doc_id", "batch_id", "which", "step")


@register("seeded", """
SELECT doc_id, (row_number() OVER (ORDER BY md5(doc_id::VARCHAR || ':42:2'), doc_id) - 1)::BIGINT AS pos FROM documents
""")
def q_seeded(spark, d):
    # O3: one seed drives the permutation; the input is deliberately re-partitioned
    # (37 parts) and the positions still equal the single-order definition
    return BT.epoch_shuffle(_docs(spark, d).repartition(37), "doc_id", seed=42, epoch=2).select("doc_id", "pos")
