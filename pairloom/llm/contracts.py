"""The queries ``opN_<name>`` and ``pipeline``: each applies its operator to a whole table and returns the agreed columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import alignment, bpe, fingerprint, language, mixing, near_dup, oracles, pii, quality, substrings, token_counts, toxicity, urls, whitening
from .common import held_out, stored, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql.strip()
        return fn
    return add


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Place of the public vocabulary file that the queries use; the operators take any path."""
    import public_tokenizers
    return public_tokenizers.path(name)


@register("op1_url_filters", oracles.URLS)
def op1_url_filters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return urls.judge_urls(pages, labels).select("page_id", "host", "path", "rule", "verdict", "mined_rule", "confidence")


@register("op2_bpe")
def op2_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, vocabulary(), ids=False, digests=True).select("doc_id", "bpe.n_tokens", "bpe.ids_sha256", "bpe.decoded_sha256")


@register("op3_toxicity")
def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out("doc_id", 5, 0))
    scored = toxicity.score(docs, toxicity.train(docs, labels), spans=False)
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), F.col("toxicity.score").alias("score"),
                         (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"))


@register("op4_token_counts")
def op4_token_counts(spark, sf_dir):
    automaton = token_counts.byte_level_automaton(vocabulary("byte_bpe_50k.json"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, automaton).select("doc_id", "tokens.n_words", "tokens.n_tokens")


@register("op5_pii")
def op5_pii(spark, sf_dir):
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "pii", F.filter("pii", lambda s: s["base"]).alias("base")).select(
        "doc_id", count("email"), count("ip"), count("card"), count("phone"),
        F.sha2(line(F.col("base")), 256).alias("base_sha256"), line(F.col("pii")).alias("spans"))


@register("op6_mixing", oracles.MIXING)
def op6_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("words"), F.xxhash64("text").alias("hash"))
    return mixing.mix(docs, F.col("words"), name=F.col("doc_id").cast("string")).select("doc_id", "size", "source_size", "target", "taken")


@register("op7_fingerprint")
def op7_fingerprint(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fingerprint.edited_neighbours(docs).drop("edited")


@register("op8_language")
def op8_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.where(~held_out("doc_id", 4, 2)))
    found = language.detect(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), F.col("language.lang").alias("lang_pred"),
                        F.col("language.score").alias("score"), F.col("language.ambiguous").alias("ambiguous"))


@register("op9_quality", oracles.QUALITY)
def op9_quality(spark, sf_dir):
    judged = quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), clean=False)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "n_left_words"]
    return judged.select("doc_id", *[F.col(f"quality.{n}") for n in names])


@register("op10_near_dup", oracles.NEAR_DUP)
def op10_near_dup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # 20 bands of 6: a pair at 0.85 shares none with probability 8e-5
    return near_dup.near_duplicates(docs, shingle=3, percent=85, bands=20, rows=6).select("doc_id", "n_shingles", "component_id", "kept")


@register("op11_whitening")
def op11_whitening(spark, sf_dir):
    white = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    each = white.select("vec_id", "whitening", F.posexplode(F.arrays_zip("whitening.values", "whitening.explained")).alias("at", "of"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "whitening.n", "whitening.deviation", F.col("of.values").alias("whitened"),
                       F.col("of.explained").alias("explained"), "whitening.identity_error")


@register("op12_substring_dedup", oracles.SUBSTRINGS)
def op12_substring_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs).select("doc_id", "repeats.n_words", "repeats.n_removed", F.sha2("repeats.kept_text", 256).alias("kept_sha256"))


@register("op13_alignment")
def op13_alignment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    aligned = stored(alignment.align(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")).drop("text"), "aligned")
    scored = alignment.score_links(aligned, alignment.pair_counts(aligned))
    return scored.select("doc_id", "alignment.n_a", "alignment.n_b", "alignment.n_groups", "n_links", "n_best", "count_sum", "alignment.groups_sha256")


@register("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
