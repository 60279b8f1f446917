"""Row numbers without a single-task window.

``row_number().over(Window.orderBy(...))`` moves every row into one task, and
``Window.partitionBy(key)`` moves a whole hot key into one task. Both break at
scale. ``row_index`` gives the same numbers in three bounded steps:

1. **Buckets.** A hash-selected sample of the composite key
   (group keys + order keys) is sorted by Spark and cut into ``B`` ranges. The
   cut points go to the tasks as they are, so every later evaluation - a
   retried task, a lost executor - assigns the same bucket. (Spark's own range
   partitioner re-samples with a seed tied to the RDD id, so two reads of "the
   same" range partitioning can disagree.) A hot group spreads over many
   buckets because the order keys are part of the bucketed key.
2. **Local numbers.** ``row_number`` over (group, bucket): each window
   partition holds about ``rows / B`` rows.
3. **Offsets.** Rows per (group, bucket), summed over earlier buckets of the
   same group with a window over that small table, and joined back.

The order keys must form a total order (put the id last) and sort
ascending; for a descending numeric key pass its negation.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLE_PER_BUCKET = 64
#: Rows of one bucket, about, and the most buckets: every task holds the cut points.
ROWS_PER_BUCKET, MAX_BUCKETS = 10_000, 4_096

# Plan nodes that make an input expensive to recompute (shuffles, joins,
# generators, Python). Such an input is written once as a table so the count,
# the sample and the numbering all read the same stored rows.
_EXPENSIVE = ("Generate", "EvalPython", "MapInPandas", "MapInArrow", "FlatMapGroupsIn", "Window", "Aggregate", "Join")


def is_expensive(df: DataFrame) -> bool:
    """Whether a node of the physical plan (its operators, not words in its text) is costly to recompute."""
    def nodes(plan):
        yield plan.nodeName()
        children = plan.children()
        for i in range(children.size()):
            yield from nodes(children.apply(i))

    plan = df._jdf.queryExecution().sparkPlan()  # before adaptive execution wraps it
    return any(mark in name for name in nodes(plan) for mark in _EXPENSIVE)


def _col(x) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    if re.search(r" (ASC|DESC) NULLS (FIRST|LAST)'>$", repr(c)):
        raise ValueError("order keys sort ascending and take no direction; negate a number to sort it descending")
    return c


#: Key types whose values sort in Python as in Spark (null first and NaN last are seen to).
_PLAIN = ("tinyint", "smallint", "int", "bigint", "string", "boolean", "date", "binary", "float", "double", "decimal")


def _ranked(value):
    """``value`` in an order with null first and NaN last."""
    if value is None:
        return (0,)
    return (2,) if value != value else (1, value)


def search(cuts: list[tuple], columns: list[pa.Array]) -> np.ndarray:
    """Number of cut points <= each key; ``columns`` hold the parts of the keys, ``cuts`` are sorted."""
    if len(columns) == 1 and pa.types.is_integer(columns[0].type) and not columns[0].null_count and cuts[0][0] is not None:
        return np.searchsorted(np.array([c[0] for c in cuts], np.int64), columns[0].to_numpy().astype(np.int64), "right")
    odd = any(c.null_count or pa.types.is_floating(c.type) for c in columns) or any(v is None for c in cuts for v in c)
    lists = [c.to_pylist() for c in columns]
    if odd:
        lists = [list(map(_ranked, x)) for x in lists]
        cuts = [tuple(map(_ranked, c)) for c in cuts]
    return np.fromiter((bisect_right(cuts, k) for k in zip(*lists, strict=True)), np.int64, len(lists[0]))


def bucket_of(key: Column, bounds: list, key_type) -> Column:
    """Number of cut points <= the struct ``key``, by binary search."""
    if not bounds:
        return F.lit(0)
    if all(f.dataType.simpleString().split("(")[0] in _PLAIN for f in key_type.fields):
        shared = SparkSession.active().sparkContext.broadcast([tuple(b) for b in bounds])

        def find(*columns: pa.Array) -> pa.Array:
            return pa.array(search(shared.value, columns), pa.int32())

        return F.arrow_udf(find, "int")(*[key[f.name] for f in key_type.fields])
    # Other types (timestamps, nested ones) are compared by Spark, in an array literal.
    arr = F.array(*[F.lit(None).cast(key_type) if b is None else
                    F.struct(*[F.lit(v).cast(f.dataType) for v, f in zip(b, key_type.fields)]).cast(key_type)
                    for b in bounds])
    n = len(bounds)
    iters = max(1, math.ceil(math.log2(n + 1)) + 1)
    init = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))

    def step(acc, _):
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        go_right = F.element_at(arr, mid + 1) <= key
        return F.when(acc["lo"] < acc["hi"],
                      F.when(go_right, F.struct((mid + 1).alias("lo"), acc["hi"].alias("hi")))
                       .otherwise(F.struct(acc["lo"].alias("lo"), mid.alias("hi")))).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(iters)), init, step)["lo"]


def assign_buckets(df: DataFrame, order_by: Sequence, partition_by: Sequence[str], nb: int,
                   name: str = "_pl_b", rows: int | None = None) -> DataFrame:
    """Add ``name``: the range bucket of the (group, order) key, cut points from a sample.

    About ``rows / nb`` rows fall in each bucket whatever the group sizes,
    because the order keys are part of the bucketed key. ``rows`` spares the count.
    """
    groups = list(partition_by)
    keys = [_col(g) for g in groups] + [_col(o) for o in order_by]
    kstruct = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    keyed = df.withColumn("_pl_key", kstruct)
    key_type = keyed.schema["_pl_key"].dataType
    bounds: list = []
    if nb > 1:
        n = keyed.count() if rows is None else rows
        every = max(1, n // (SAMPLE_PER_BUCKET * nb))
        sample = (keyed.select("_pl_key")
                       .where(F.pmod(F.xxhash64("_pl_key"), F.lit(every)) == 0)
                       .orderBy("_pl_key").collect())
        s = len(sample)
        if s > 0:
            seen = []
            for i in range(1, nb):
                cut = tuple(sample[min(s - 1, (i * s) // nb)]["_pl_key"])
                if not seen or cut != seen[-1]:
                    seen.append(cut)
            bounds = seen
    return keyed.withColumn(name, bucket_of(F.col("_pl_key"), bounds, key_type).cast("int")).drop("_pl_key")


def row_index(df: DataFrame, order_by: Sequence, partition_by: Sequence[str] = (),
              name: str = "rn", num_buckets: int | None = None, start: int = 1,
              cut_lineage: bool | None = None) -> DataFrame:
    """Add ``name``: row number within ``partition_by`` following ``order_by``.

    ``cut_lineage`` (default: when the input plan is expensive) writes the
    input once as a table in the shared checkpoint folder first.
    """
    spark = df.sparkSession
    if cut_lineage is None:
        cut_lineage = is_expensive(df)
    if cut_lineage:
        from ..session import cut_lineage as _cut
        df = _cut(df, "row-index")
    groups = list(partition_by)
    n = df.count()
    nb = num_buckets or max(1, min(math.ceil(n / ROWS_PER_BUCKET), MAX_BUCKETS))
    if nb == 1:
        w = Window.partitionBy(*(groups or [F.lit(0)])).orderBy(*[_col(o) for o in order_by])
        return df.withColumn(name, (F.row_number().over(w) + F.lit(start - 1)).cast("long"))
    b = assign_buckets(df, order_by, groups, nb, rows=n)
    local = b.withColumn("_pl_r", F.row_number().over(
        Window.partitionBy(*groups, "_pl_b").orderBy(*[_col(o) for o in order_by])))
    stats = b.groupBy(*groups, "_pl_b").agg(F.count(F.lit(1)).alias("_pl_n"))
    w = Window.partitionBy(*groups).orderBy("_pl_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = stats.select(*[F.col(g).alias(f"_pl_g{i}") for i, g in enumerate(groups)],
                        F.col("_pl_b").alias("_pl_bb"),
                        F.coalesce(F.sum("_pl_n").over(w), F.lit(0)).alias("_pl_off"))
    cond = [local["_pl_b"] == offs["_pl_bb"]] + [local[g].eqNullSafe(offs[f"_pl_g{i}"])
                                                 for i, g in enumerate(groups)]
    out = local.join(offs, cond, "inner")
    out = out.withColumn(name, (F.col("_pl_r") + F.col("_pl_off") + F.lit(start - 1)).cast("long"))
    return out.drop("_pl_b", "_pl_r", "_pl_bb", "_pl_off", *[f"_pl_g{i}" for i in range(len(groups))])
