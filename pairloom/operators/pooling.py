"""Pooling of token vectors into one vector per sequence (A11-A14), position ids (W3), and
the named pooler registry (F5).

Input is long form: one row per (sequence, position) with a vector. Every
pooler is an aggregation with a partial (map-side) step, so a long or hot
sequence is combined in pieces; only the final per-sequence vector (width =
the vector dimension) is assembled in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..plans.indexing import row_index


def _partial(rows: DataFrame, seq: str, vec: str, weight: str, combine: str) -> DataFrame:
    """(seq, part, n): per task one vector per sequence, summed or taken the maximum of in numpy.

    The map-side half of an aggregation over vectors: what reaches the shuffle is a vector per task and
    sequence, not a row per element. Sequences held at once are bounded; a full table is passed on early.
    """
    kind = rows.schema[seq].dataType.simpleString()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def parts() -> pd.DataFrame:
            out = pd.DataFrame({seq: list(held), "part": [v.tolist() for v, _ in held.values()], "n": [float(n) for _, n in held.values()]})
            held.clear()
            return out

        for pdf in it:
            pdf = pdf[pdf[vec].notna()]
            if not len(pdf):
                continue
            matrix = np.stack(pdf[vec].to_numpy()).astype(np.float64)
            w = pdf[weight].to_numpy(np.float64)
            codes, keys = pd.factorize(pdf[seq], use_na_sentinel=False)
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0])
            sums = np.add.reduceat((matrix * w[:, None])[order], starts) if combine == "sum" else np.maximum.reduceat(matrix[order], starts)
            counts = np.add.reduceat(w[order], starts)
            for key, v, n in zip(keys[codes[order][starts]], sums, counts, strict=True):
                if key in held:
                    old, m = held[key]
                    v, n = (old + v if combine == "sum" else np.maximum(old, v)), m + n
                held[key] = (v, n)
            if len(held) > 4096:
                yield parts()
        if held:
            yield parts()

    slim = rows.select(F.col(seq), V.as_double(vec).alias(vec), F.col(weight).cast("double").alias(weight))
    return slim.mapInPandas(run, f"{seq} {kind}, part array<double>, n double")


def _merge(parts: DataFrame, seq: str, combine: str) -> DataFrame:
    """Parts of a sequence into one: sorted by sequence, reduced run by run; the last run of a batch goes on in the next.

    A task holds one batch and one open sequence, however many sequences or parts of one it meets.
    """
    reduce = (np.add if combine == "sum" else np.maximum).reduceat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.concat_batches([held, batch]) if held is not None else batch
            codes = rows[seq].dictionary_encode("encode").indices.to_numpy()
            starts = np.flatnonzero(np.r_[True, np.diff(codes) != 0])
            matrix = rows["part"].flatten().to_numpy().reshape(rows.num_rows, -1)
            sums = reduce(matrix, starts, axis=0)
            offsets = pa.array(np.arange(len(starts) + 1, dtype=np.int32) * matrix.shape[1], pa.int32())
            done = pa.RecordBatch.from_arrays([rows[seq].take(pa.array(starts)), pa.ListArray.from_arrays(offsets, pa.array(sums.ravel())),
                                               pa.array(np.add.reduceat(rows["n"].to_numpy(), starts))], names=[seq, "part", "n"])
            yield done.slice(0, len(starts) - 1)
            held = pa.RecordBatch.from_pylist(done.slice(len(starts) - 1).to_pylist(), schema=batch.schema)
        if held is not None:
            yield held

    kind = f"{seq} {parts.schema[seq].dataType.simpleString()}, part array<double>, n double"
    return parts.repartition(seq).sortWithinPartitions(seq, "n").mapInArrow(run, kind)


def pool_mean(df: DataFrame, seq: str, vec: str, mask: str) -> DataFrame:
    """sum(vec * mask) / sum(mask) per dimension; null for a sequence without valid positions."""
    sums = _merge(_partial(df, seq, vec, mask, "sum"), seq, "sum")
    return sums.select(seq, F.when(F.col("n") != 0, F.transform("part", lambda x: x / F.col("n"))).alias("pooled"))


def pool_max(df: DataFrame, seq: str, vec: str, mask: str) -> DataFrame:
    """Max over valid (mask = 1) positions per dimension."""
    best = _merge(_partial(df.filter(F.col(mask) == 1), seq, vec, mask, "max"), seq, "max")
    return best.select(seq, F.col("part").alias("pooled"))


def pool_first(df: DataFrame, seq: str, vec: str, pos: str, cls_position: int = 0) -> DataFrame:
    """The vector at ``cls_position`` (the first token)."""
    return (df.filter(F.col(pos) == cls_position)
              .groupBy(seq).agg(F.min_by(V.as_double(vec), F.col(pos)).alias("pooled")))


def pool_eos(df: DataFrame, seq: str, vec: str, pos: str, token: str, eos_id: int | None = None) -> DataFrame:
    """The vector at the largest token id (first position on ties), or where token = eos_id."""
    if eos_id is not None:
        return (df.filter(F.col(token) == eos_id).groupBy(seq)
                  .agg(F.min_by(V.as_double(vec), F.col(pos)).alias("pooled")))
    return df.groupBy(seq).agg(F.max_by(V.as_double(vec), F.struct(F.col(token), -F.col(pos))).alias("pooled"))


def position_ids(df: DataFrame, seq: str, pos: str, token: str, pad_id: int = 1,
                 name: str = "position_id") -> DataFrame:
    """Pad + running count of non-pad tokens; pads get the pad id.

    The running count is the rank among the sequence's non-pad rows, computed
    with the skew-safe ``row_index`` rather than a window over the sequence.
    """
    real = df.filter(F.col(token) != pad_id)
    ranked = row_index(real, [pos], partition_by=[seq], name="_rk", start=1)
    ranked = ranked.withColumn(name, (F.col("_rk") + F.lit(pad_id)).cast("long")).drop("_rk")
    pads = df.filter(F.col(token) == pad_id).withColumn(name, F.lit(pad_id).cast("long"))
    return ranked.unionByName(pads)


def position_ids_array(ids, pad_id: int = 1):
    """W3 on an ids array column (one sequence per row): a running count over the flat values, restarted at each row.

    A null id counts as padding; a null array stays null.
    """

    def run(lists: pa.Array) -> pa.Array:
        offsets = lists.offsets.to_numpy().astype(np.int64)
        real = pc.fill_null(lists.flatten(), pad_id).to_numpy() != pad_id
        seen = np.r_[0, np.cumsum(real)]
        starts = offsets - offsets[0]
        each = np.diff(starts)
        out = np.where(real, pad_id + seen[1:] - np.repeat(seen[starts[:-1]], each), pad_id)
        return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(out.astype(np.int64)))

    c = F.col(ids) if isinstance(ids, str) else ids
    # an empty array in the place of null keeps the offsets of the flat values right
    made = F.arrow_udf(run, "array<long>")(F.coalesce(c, F.array()).cast("array<long>"))
    return F.when(c.isNotNull(), made)


#: Poolers by name, all over long-form rows (sequence, position, vector). Add to it to register another.
POOLERS: dict[str, Callable[..., DataFrame]] = {"mean": pool_mean, "max": pool_max, "first": pool_first, "eos": pool_eos}
