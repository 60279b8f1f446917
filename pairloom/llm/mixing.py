"""Mixing sources to target weights (6).

Every document gets a hash-random key. Slices of the key's range split each source, however large, into
buckets; prefix sums of the sizes are taken within buckets and over the table of bucket sums. A source
that must give ``target`` words repeats all its documents floor(target / size) times and then, in key order, takes
documents until the rest of the budget is exactly spent; the document at the cut gives its first words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.indexing import row_index
from .common import SPACE_CLASS, WORD_CLASS, stored

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Rows of the largest source that fall in one bucket, about.
BUCKET_ROWS = 2_000
SEED = 42


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"{WORD_CLASS}+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size).

    Sources in code-point order, null last, take the weights in turn and share the sum of all sizes by weight. A share above
    ``max_epochs`` times the source's size stops there; the rest goes by weight to the others until none is above.
    Only sums come to the driver, one round at a time.
    """
    keyed = sizes.withColumn("_llm_last", F.col("source").isNull().cast("int")).withColumn("_llm_name", F.coalesce("source", F.lit("")))
    numbered = row_index(keyed, ["_llm_last", "_llm_name"], name="_llm_at", start=0)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_llm_at") % len(weights) + 1).cast("int"))
    rows = stored(numbered.select("source", "source_size", weight.alias("weight")), "source-weights")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    limit = F.col("source_size") * max_epochs
    free, level = F.lit(True), None
    while True:
        left = rows.where(free).agg(F.sum("weight")).first()[0]
        if not left:
            break
        spent = rows.where(~free).agg(F.sum(limit)).first()[0] or 0
        level = F.lit(float(total - spent)) * F.col("weight") / F.lit(float(left))
        if rows.where(free & (level > limit)).isEmpty():
            break
        # Two numbers a round tell which sources stop: no list of sources reaches the driver.
        free = free & ~(level > limit)
    share = F.lit(0.0) if level is None else level
    return rows.withColumn("target", F.when(free, share).otherwise(limit.cast("double")))


def random_key(name: Column, seed: int = SEED) -> Column:
    """60 hash-random bits of a row's name: the first 15 digits of md5(seed:name)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), name)), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, size: Column, source: str = "source", name: Column | None = None, weights=WEIGHTS,
        max_epochs: int = MAX_EPOCHS, seed: int = SEED, prefix: str = "") -> DataFrame:
    """Add ``{prefix}size, {prefix}source_size, {prefix}target, {prefix}epochs, {prefix}rest, {prefix}taken`` to every row.

    A row is taken whole ``epochs`` times and then its first ``rest`` words once (0: not; its size: whole);
    ``taken`` = epochs * size + rest. ``name`` (a string; default: all columns as JSON) is hashed with ``seed`` to order the
    rows of a source; rows of one name are ordered by a hash of all columns, and equal rows are interchangeable. Texts without
    words have size 0 and take nothing. A null source is a source. An empty table gives an empty table.
    """
    plain = [F.col(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    name = F.to_json(F.struct(*plain)) if name is None else name
    # The second hash parts ties, so that reruns agree whatever the partitioning.
    made = docs.withColumns({"_llm_size": size, "_llm_key": random_key(F.coalesce(name, F.lit("")), seed), "_llm_tie": F.xxhash64(F.lit(seed), *plain)})
    source_of = F.col(source).cast("string")
    # 65536 equal slices of the key range, joined into as many buckets as the largest source needs.
    slice_of = F.shiftright("_llm_key", 44).cast("int")
    fine = stored(made.groupBy(source_of.alias("source"), slice_of.alias("slice")).agg(
        F.sum("_llm_size").alias("words"), F.count(F.lit(1)).alias("n")), "slice-sums")
    largest = fine.groupBy("source").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    per_bucket = max(1, min(65536, 65536 * BUCKET_ROWS // max(1, largest)))
    targets = source_targets(fine.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    bucket = lambda c: F.floor(c / per_bucket).cast("int")
    # Never null, so that the window's partitioning serves the join as well.
    label = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    sums = fine.groupBy(label(F.col("source")).alias("_llm_of"), bucket(F.col("slice")).alias("_llm_bucket")).agg(F.sum("words").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("_llm_of").orderBy("_llm_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = targets.select(label(F.col("source")).alias("_llm_of"), F.col("source_size").alias("_llm_total"), F.col("target").alias("_llm_target"))
    starts = stored(sums.withColumn("_llm_before", before).drop("words").join(ends, "_llm_of"), "bucket-starts")
    in_bucket = Window.partitionBy("_llm_of", "_llm_bucket").orderBy("_llm_key", "_llm_tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = made.withColumns({"_llm_of": label(source_of), "_llm_bucket": bucket(slice_of)})
    rows = rows.withColumn("_llm_local", F.coalesce(F.sum("_llm_size").over(in_bucket), F.lit(0))).join(starts, ["_llm_of", "_llm_bucket"])
    budget = F.floor("_llm_target").cast("long")
    epochs = F.when(F.col("_llm_total") > 0, F.expr("CAST(floor(_llm_target) AS BIGINT) DIV greatest(_llm_total, 1L)")).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("_llm_epochs", epochs)
    rest = F.greatest(F.lit(0), F.least("_llm_size", budget - F.col("_llm_epochs") * F.col("_llm_total") - F.col("_llm_before") - F.col("_llm_local"))).cast("long")
    rows = rows.withColumn("_llm_rest", rest)
    named = {"size": F.col("_llm_size"), "source_size": F.col("_llm_total"), "target": F.col("_llm_target"), "epochs": F.col("_llm_epochs"),
             "rest": F.col("_llm_rest"), "taken": F.col("_llm_epochs") * F.col("_llm_size") + F.col("_llm_rest")}
    own = {prefix + k for k in named}
    return rows.select(*[c for c in docs.columns if c not in own], *[v.alias(prefix + k) for k, v in named.items()])


def mixed_rows(docs: DataFrame, text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as often as it is taken, the one at a cut with its first words only."""
    rows = mix(docs, word_count(F.col(text)), source, prefix="_llm_out_", **how)
    first = F.call_function("regexp_extract", F.col(text), F.concat(F.lit(f"^(?:{SPACE_CLASS}*+{WORD_CLASS}++){{"), F.col("_llm_out_rest").cast("string"), F.lit("}+")), F.lit(0))
    partial = (F.col("_llm_out_rest") > 0) & (F.col("_llm_out_rest") < F.col("_llm_out_size"))
    whole = F.col("_llm_out_epochs") + F.when(F.col("_llm_out_rest") > 0, 1).otherwise(0)
    copies = rows.withColumn("_llm_copy", F.explode(F.when(whole > 0, F.sequence(F.lit(1), whole.cast("int"))).otherwise(F.array().cast("array<int>"))))
    cut = partial & (F.col("_llm_copy") > F.col("_llm_out_epochs"))
    return copies.withColumn(text, F.when(cut, first).otherwise(F.col(text))).select(*docs.columns)
