"""The corpus pipeline: quality rules, near-duplicates, personal data, source mix, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as a table in the
shared checkpoint folder and rereads them, so a lost executor never reaches further back than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import bpe, mixing, near_dup, pii, quality
from pairloom.llm.common import stored, table
from pairloom.llm.contracts import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose the boilerplate lines of their source."""
    judged = quality.quality(docs.withColumnRenamed("quality", "_stage_quality") if "quality" in docs.columns else docs)
    clean = judged.where(F.col("quality.kept")).withColumn("text", F.col("quality.clean_text")).drop("quality")
    return counted(clean.withColumnRenamed("_stage_quality", "quality")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays (five-word shingles, similarity 0.8)."""
    return near_dup.one_of_each_group(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kind's name."""
    return counted(pii.redact(docs)).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat or go so that each source has its target of words."""
    return counted(mixing.mixed_rows(docs)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids: what a training job reads."""
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), vocabulary()).select("doc_id", "lang", "source", "bpe.n_tokens", "bpe.ids")


def counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` brought up to date where the column exists."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_duplicates), ("personal data", personal_data),
          ("source mix", source_mix), ("bpe", tokens)]

#: No SQL for MinHash groups, hash order and BPE: tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
