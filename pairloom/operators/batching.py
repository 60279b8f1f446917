"""Batching, sharding and ordering.

The reference is positional: batches and shards are runs of consecutive rows.
Here every position comes from an explicit order (``row_index``), so results
do not depend on how Spark partitioned the input.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.indexing import row_index


def seeded_key(id_col, seed: int, *salts) -> Column:
    """O3: a deterministic pseudo-random key, md5 of ``id:seed[:salt...]``.

    Same value whatever the partitioning or executor; never ``rand()``.
    """
    parts = [F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string"),
             F.lit(str(seed))] + [F.lit(str(s)) for s in salts]
    return F.md5(F.concat_ws(":", *parts))


def seeded_int(id_col, seed: int, *salts) -> Column:
    """First 8 hex digits of ``seeded_key`` as a non-negative long."""
    return F.conv(F.substring(seeded_key(id_col, seed, *salts), 1, 8), 16, 10).cast("long")


def position(df: DataFrame, order_by: Sequence, name: str = "pos") -> DataFrame:
    """0-based global position in ``order_by`` (a total order), no single-task window."""
    return row_index(df, order_by, name=name, start=0)


def batch_ids(df: DataFrame, size: int, order_by: Sequence, drop_last: bool = False,
              name: str = "batch_id") -> DataFrame:
    """Consecutive batches of ``size`` rows in ``order_by`` order."""
    p = position(df, order_by, "_pl_pos")
    if drop_last:
        full = (df.count() // size) * size
        p = p.filter(F.col("_pl_pos") < full)
    return p.withColumn(name, F.floor(F.col("_pl_pos") / size).cast("long")).drop("_pl_pos")


def contiguous_shards(df: DataFrame, k: int, order_by: Sequence, name: str = "shard") -> DataFrame:
    """Runs of ceil(n/k) rows per shard; the last shard is short or empty (not ntile)."""
    n = df.count()
    per = max(1, math.ceil(n / k))
    p = position(df, order_by, "_pl_pos")
    return p.withColumn(name, F.floor(F.col("_pl_pos") / per).cast("long")).drop("_pl_pos")


def round_robin_shards(df: DataFrame, batch: int, world: int, order_by: Sequence,
                       name: str = "rank") -> DataFrame:
    """Batch-size slices dealt in turn to ``world`` workers."""
    p = position(df, order_by, "_pl_pos")
    return p.withColumn(name, F.pmod(F.floor(F.col("_pl_pos") / batch), F.lit(world)).cast("long")).drop("_pl_pos")


def natural_key(col) -> Column:
    """O1: case-insensitive key with digit runs compared as numbers (``src2 < src10``), of any length.

    A run becomes its length without leading zeros (fixed width) and then its digits: longer runs are larger numbers.
    """
    c = F.col(col) if isinstance(col, str) else col
    toks = F.regexp_extract_all(F.lower(c), F.lit(r"([0-9]+|[^0-9]+)"), 1)

    def key(t):
        digits = F.ltrim(t, F.lit("0"))
        return F.when(t.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(t)

    return F.array_join(F.transform(toks, key), "")


def natural_sort(df: DataFrame, col: str, tie: str | None = None, name: str = "rank") -> DataFrame:
    """O1: 1-based rank in natural order."""
    order = [natural_key(col), F.col(tie or col)]
    return row_index(df, order, name=name, start=1)


def epoch_shuffle(df: DataFrame, id_col: str, seed: int, epoch: int, name: str = "pos") -> DataFrame:
    """O2: a new deterministic permutation per epoch; reusable for a second table (same ids)."""
    return row_index(df, [seeded_key(id_col, seed, epoch), F.col(id_col)], name=name, start=0)


def resume_after(df: DataFrame, step: int, steps_per_epoch: int, accumulation: int = 1,
                 batch_col: str = "batch_id") -> DataFrame:
    """Drop the batches already used in the current epoch before a checkpoint.

    Whole epochs are skipped by the caller's epoch number (``step //
    steps_per_epoch``); in the current one, ``(step % steps_per_epoch) x
    accumulation`` batches are skipped.
    """
    skip = (step % steps_per_epoch) * accumulation
    return df.filter(F.col(batch_col) >= skip).withColumn("epoch", F.lit(step // steps_per_epoch).cast("long"))


def collate(df: DataFrame, batch_col: str, order_col: str, fields: Sequence[str],
            pad: dict[str, object] | None = None) -> DataFrame:
    """rows of a batch (bounded by the batch size) -> one record of arrays.

    Array fields named in ``pad`` are right-padded to the longest in the batch.
    """
    pad = pad or {}
    g = (df.groupBy(batch_col)
           .agg(F.sort_array(F.collect_list(F.struct(F.col(order_col).alias("_o"), *fields))).alias("_rows")))
    out = [batch_col, F.transform("_rows", lambda r: r["_o"]).alias(order_col)]
    for f in fields:
        col = F.transform("_rows", _field(f))
        if f in pad:
            width = F.array_max(F.transform(col, lambda a: F.size(a)))
            col = F.transform(col, lambda a: F.concat(a, F.array_repeat(F.lit(pad[f]).cast(
                "long" if isinstance(pad[f], int) else "double"), width - F.size(a))))
        out.append(col.alias(f))
    return g.select(*out)


def _field(name: str):
    def get(r):
        return r[name]
    return get


def interleave(main: DataFrame, sub: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """One batch from each side in turn, stopping at the shorter side.

    Returns both sides' rows with ``which`` (0 main, 1 sub) and ``step`` =
    2 x batch + which. With no sub side the main side is returned alone.
    """
    if sub is None:
        return main.withColumn("which", F.lit(0)).withColumn("step", F.col(batch_col) * 2)
    common = (main.select(batch_col).distinct()
                  .join(sub.select(batch_col).distinct(), batch_col, "left_semi"))
    a = main.join(common, batch_col, "left_semi").withColumn("which", F.lit(0))
    b = sub.join(common, batch_col, "left_semi").withColumn("which", F.lit(1))
    return a.unionByName(b).withColumn("step", (F.col(batch_col) * 2 + F.col("which")).cast("long"))
