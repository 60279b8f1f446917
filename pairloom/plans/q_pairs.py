"""Checked queries: pair shaping, splits, unpivots, unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions import vectors as V
from ..operators import batching as BT
from ..operators import pairs as PR
from ..operators import udf as U
from ..session import cut_lineage, load
from . import fixtures as fx
from .q_text import SQL_FTOKENS, SQL_TOK, f_tokens, tokens_sql
from .registry import register

SQL_HASHED = SQL_TOK + """,
hb AS (SELECT doc_id, ('0x' || substr(md5(token), 1, 8))::BIGINT % 64 AS b,
              CASE WHEN ('0x' || substr(md5(token), 9, 1))::INTEGER < 8 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s
       FROM tok),
sp AS (SELECT doc_id, b, sum(s) AS v FROM hb GROUP BY doc_id, b),
grid AS (SELECT d.doc_id, r.i FROM (SELECT DISTINCT doc_id FROM sp) d
         CROSS JOIN (SELECT unnest(generate_series(0, 63)) AS i) r),
dn AS (SELECT grid.doc_id, list(coalesce(sp.v, 0.0) ORDER BY grid.i) AS vec
       FROM grid LEFT JOIN sp ON sp.doc_id = grid.doc_id AND sp.b = grid.i GROUP BY grid.doc_id),
hashed AS (SELECT documents.doc_id,
                  CASE WHEN list_sum(list_transform(vec, lambda y: y * y)) > 0 THEN
                       list_transform(vec, lambda x: round(x / sqrt(list_sum(list_transform(vec, lambda y: y * y))), 4) + 0.0)
                  END AS embedding
           FROM documents LEFT JOIN dn USING (doc_id))"""


@register("select_pair", f"WITH {fx.SQL_PAIRS} SELECT id, target_text AS student_text, source_text AS teacher_text FROM f_pairs")
def q_select_pair(spark, d):
    return PR.select_pair(fx.f_pairs(spark, d), "target_text", "source_text")


@register("prune_columns", f"WITH {fx.SQL_PAIRS} SELECT id, source_text, target_text FROM f_pairs")
def q_prune_columns(spark, d):
    return PR.prune_columns(fx.f_pairs(spark, d), drop=["lang"])


@register("resolve_columns", "SELECT page_id, url AS image_path, html AS caption FROM pages")
def q_resolve_columns(spark, d):
    pages = load(spark, d, "pages")
    img, cap = PR.resolve_columns(pages.drop("page_id"), mapping={"pages": ("url", "html")}, dataset="pages")
    return pages.select("page_id", F.col(img).alias("image_path"), F.col(cap).alias("caption"))


@register("take_n", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100")
def q_take_n(spark, d):
    return PR.take_n(load(spark, d, "documents").select("doc_id", "lang"), 100, ["doc_id"])


@register("exact_split", """
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id) <= 100
                    THEN 'validation' ELSE 'train' END AS split
FROM documents
""")
def q_exact_split(spark, d):
    return PR.exact_split(load(spark, d, "documents").select("doc_id"), "doc_id", 100, 42)


_UNPIVOT_SQL = " UNION ALL ".join(
    f"SELECT id, '{l}' AS lang, {l} AS source_text, en AS target_text FROM f_captions WHERE {l} IS NOT NULL"
    for l in fx.CAPTION_LANGS)


@register("unpivot_captions", f"WITH {fx.SQL_CAPTIONS} {_UNPIVOT_SQL}")
def q_unpivot_captions(spark, d):
    return PR.unpivot_captions(fx.f_captions(spark, d), "id", fx.CAPTION_LANGS)


@register("unpivot_caption_maps", f"""WITH {fx.SQL_CAPTIONS}, u AS ({_UNPIVOT_SQL})
SELECT id, CASE WHEN lang IN ('en', 'fr') THEN 0 ELSE 1 END AS item, lang, source_text,
       CASE WHEN lang IN ('en', 'fr') THEN target_text END AS target_text FROM u""")
def q_unpivot_caption_maps(spark, d):
    """Two maps an item: one with English and French, one with German and Spanish, hence without a target."""
    def as_map(langs):
        pairs = F.filter(F.array(*[F.struct(F.lit(l).alias("k"), F.col(l).alias("v")) for l in langs]), lambda e: e["v"].isNotNull())
        return F.map_from_entries(pairs)
    maps = fx.f_captions(spark, d).select("id", F.array(as_map(["en", "fr"]), as_map(["de", "es"])).alias("maps"))
    return PR.unpivot_caption_maps(maps, "id", "maps")


_STACK_SQL = " UNION ALL ".join(
    f"SELECT id, {i} AS li, '{l}' AS lang, {l} AS caption FROM f_captions WHERE {l} IS NOT NULL"
    for i, l in enumerate(fx.CAPTION_LANGS))


@register("stack_captions", f"""WITH {fx.SQL_CAPTIONS}, st AS ({_STACK_SQL})
SELECT id, lang, caption, (row_number() OVER (ORDER BY li, id) - 1)::BIGINT AS ord FROM st""")
def q_stack_captions(spark, d):
    return PR.stack_captions(fx.f_captions(spark, d), "id", fx.CAPTION_LANGS).select("id", "lang", "caption", "ord")


@register("language_subset", "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'fr')")
def q_language_subset(spark, d):
    return PR.language_subset(load(spark, d, "documents").select("doc_id", "lang"), "lang", ["en", "fr"])


@register("require_splits", "SELECT lang, count(*) AS n FROM documents WHERE lang IN ('en', 'fr') GROUP BY lang")
def q_require_splits(spark, d):
    return PR.require_splits(load(spark, d, "documents").select("lang"), "lang", ["en", "fr"])


@register("bilingual_double", f"""WITH {fx.SQL_PAIRS}
SELECT id, 0 AS part, target_text AS student_text, source_text AS teacher_text FROM f_pairs
UNION ALL SELECT id, 1, source_text, source_text FROM f_pairs""")
def q_bilingual_double(spark, d):
    return PR.bilingual_double(fx.f_pairs(spark, d))


@register("ordered_union_distinct", f"""WITH {fx.SQL_PAIRS},
c AS (SELECT id, list_concat({tokens_sql("source_text")}, {tokens_sql("target_text")}) AS l FROM f_pairs),
x AS (SELECT id, unnest(generate_series(1, len(l))) AS i, unnest(l) AS t FROM c),
f AS (SELECT id, t, min(i) AS i FROM x GROUP BY id, t)
SELECT id, list(t ORDER BY i) AS merged FROM f GROUP BY id""")
def q_ordered_union_distinct(spark, d):
    p = fx.f_pairs(spark, d).select("id", TX.tokens("source_text").alias("a"), TX.tokens("target_text").alias("b"))
    return p.select("id", PR.ordered_union_distinct("a", "b").alias("merged"))


@register("concat_parts_padded", f"""WITH {SQL_FTOKENS}
SELECT doc_id, list_concat(ids, list_resize([]::BIGINT[], greatest(80, (SELECT max(len(ids)) FROM f_tokens)) - len(ids), -100)) AS ids FROM f_tokens""")
def q_concat_parts_padded(spark, d):
    """Rows of many widths: all token ids of every document; some rows come again in a second part."""
    t = cut_lineage(f_tokens(spark, d), "padded-parts")
    return PR.concat_parts([t, t.filter(F.col("doc_id") < 8)], "doc_id", pad={"ids": 80})


@register("concat_parts", "SELECT vec_id, label FROM embeddings")
def q_concat_parts(spark, d):
    emb = BT.batch_ids(load(spark, d, "embeddings").select("vec_id", "label"), 64, ["vec_id"])
    last = emb.agg(F.max("batch_id").alias("m")).first()["m"]
    # the last, short batch padded by repeating its rows, as a gathered output would be
    padding = emb.filter(F.col("batch_id") == last)
    return PR.concat_parts([emb, padding], "vec_id").select("vec_id", "label")


@register("attach_vectors", f"""WITH {SQL_HASHED}
SELECT d.doc_id, d.lang, h.embedding FROM documents d LEFT JOIN hashed h USING (doc_id)""")
def q_attach_vectors(spark, d):
    docs = load(spark, d, "documents")
    vecs = U.embed_corpus(docs, "doc_id", "text")
    vecs = vecs.select("doc_id", V.vec_round("embedding").alias("embedding"))
    return PR.attach_vectors(docs.select("doc_id", "lang"), vecs, "doc_id")
