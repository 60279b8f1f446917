"""Metric aggregations (A1-A4, A7-A10, A17, A20, A21) and the J1 alignment.

All are single-pass aggregations with partial (map-side) combining, so a hot
group never lands in one task whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..plans.indexing import row_index


def _sq_diff_sum(x, y) -> Column:
    d = F.zip_with(V.as_double(x), V.as_double(y), lambda a, b: (a - b) * (a - b))
    return F.aggregate(d, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def _abs_diff_sum(x, y) -> Column:
    d = F.zip_with(V.as_double(x), V.as_double(y), lambda a, b: F.abs(a - b))
    return F.aggregate(d, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def mse(x: str, y: str) -> Column:
    """A1: mean of squared differences over all elements (aggregate expression)."""
    return F.sum(_sq_diff_sum(x, y)) / F.sum(F.size(x))


def mean_cosine(x: str, y: str) -> Column:
    """A2: mean cosine of matched rows (aggregate expression)."""
    return F.avg(V.cosine(x, y))


def cosine_loss(x: str, y: str) -> Column:
    """A3: mean of 1 - cos, target +1 (aggregate expression)."""
    return F.avg(F.lit(1.0) - V.cosine(x, y))


def l1(x: str, y: str) -> Column:
    """A4: mean absolute difference over all elements (aggregate expression)."""
    return F.sum(_abs_diff_sum(x, y)) / F.sum(F.size(x))


def eval_report(df: DataFrame, x: str, y: str, prefix: str = "eval", digits: int = 4) -> DataFrame:
    """The metric suite in one pass, as (name, value) rows, rounded.

    Keys get ``prefix_`` unless they already start with it.
    """
    metrics = {"mse": mse(x, y), "cosine": mean_cosine(x, y), "cosine_loss": cosine_loss(x, y),
               "l1": l1(x, y)}
    agg = df.agg(*[m.alias(k) for k, m in metrics.items()])

    def key(k: str) -> str:
        return k if k.startswith(f"{prefix}_") else f"{prefix}_{k}"

    stacked = F.explode(F.array(*[F.struct(F.lit(key(k)).alias("name"),
                                           V.num_round(F.col(k), digits).alias("value")) for k in metrics]))
    return agg.select(stacked.alias("m")).select("m.*")


def align_pairs(student: DataFrame, teacher: DataFrame, id_col: str, check: bool = True) -> DataFrame:
    """Row i of the student table with row i of the teacher table, by id.

    With ``check`` every id must stand exactly once on either side: one pass counts both sides per id, and an
    id that is missing, repeated or null is an error.
    """
    if check:
        side = lambda df, s, t: df.select(F.col(id_col).alias("id"), F.lit(s).alias("s"), F.lit(t).alias("t"))
        counts = side(student, 1, 0).unionByName(side(teacher, 0, 1)).groupBy("id").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
        odd = counts.filter((F.col("s") != 1) | (F.col("t") != 1) | F.col("id").isNull()).first()
        if odd is not None:
            raise ValueError(f"align_pairs: id {odd['id']} stands {odd['s']} times on the student side, {odd['t']} times on the teacher side")
    return student.join(teacher, id_col, "inner")


def eval_loss(df: DataFrame, batch_col: str, loss_col: str) -> DataFrame:
    """Batch means weighted by batch size (short last batch by its size)."""
    per = df.groupBy(batch_col).agg(F.avg(loss_col).alias("m"), F.count(F.lit(1)).alias("n"))
    return per.agg((F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("eval_loss"),
                   F.count(F.lit(1)).alias("n_batches"), F.sum("n").alias("n_rows"))


def interval_loss(log: DataFrame, step_col: str, loss_col: str, every: int) -> DataFrame:
    """Logged loss per interval of ``every`` steps, and the final train loss.

    Inside an interval the running sum S takes ``S += x`` for a finite step
    and ``S *= 1 + 1/j`` for a NaN/Inf step at position j (1-based). Closed
    form: S = sum_j x_j * prod_{i>j} m_i, the product as exp(sum(ln m)) over
    a window inside the interval (groups bounded by ``every``).
    Returns rows (interval, n_steps, loss); interval -1 holds the train loss
    (sum of all S over the number of steps).
    """
    p = row_index(log.select(step_col, loss_col), [step_col], name="_i", start=0)
    p = p.withColumn("interval", F.floor(F.col("_i") / every).cast("long"))
    p = p.withColumn("j", (F.col("_i") - F.col("interval") * every + 1).cast("double"))
    bad = F.isnan(loss_col) | (F.abs(F.col(loss_col)) == float("inf"))
    p = p.withColumn("x", F.when(bad, F.lit(0.0)).otherwise(F.col(loss_col)))
    p = p.withColumn("lnm", F.when(bad, F.log(1 + 1 / F.col("j"))).otherwise(F.lit(0.0)))
    w = Window.partitionBy("interval").orderBy("_i").rowsBetween(1, Window.unboundedFollowing)
    p = p.withColumn("after", F.coalesce(F.sum("lnm").over(w), F.lit(0.0)))
    per = p.groupBy("interval").agg(F.sum(F.col("x") * F.exp("after")).alias("S"),
                                    F.count(F.lit(1)).alias("n_steps"))
    # rollup: each interval and, in the same pass, all of them together
    both = per.rollup("interval").agg(F.sum("S").alias("S"), F.sum("n_steps").alias("n_steps"))
    return both.select(F.coalesce("interval", F.lit(-1).cast("long")).alias("interval"), "n_steps", (F.col("S") / F.col("n_steps")).alias("loss"))


def sample_counts(df: DataFrame, split_col: str, max_samples: int) -> DataFrame:
    """A10: rows per split and min(max_samples, rows)."""
    return (df.groupBy(split_col)
              .agg(F.count(F.lit(1)).alias("n_rows"))
              .withColumn("n_samples", F.least(F.col("n_rows"), F.lit(max_samples)).cast("long")))


def density_histogram(df: DataFrame, col: str, bins: int = 200) -> DataFrame:
    """Equal-width histogram with area 1, all ``bins`` rows; the maximum goes in the last bin.

    Null, NaN and infinite values do not count. Without any value there is no range and no row.
    The range is two scalars computed first (one small aggregate action).
    """
    x = F.col(col).cast("double")
    some = df.select(x.alias("x")).filter(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    r = some.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("n")).first()
    n = int(r["n"])
    lo, hi = (float(r["lo"]), float(r["hi"])) if n else (0.0, 1.0)
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((F.col("x") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("long")
    counts = some.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every = df.sparkSession.range(bins if n else 0).withColumnRenamed("id", "bin")
    return (every.join(counts, "bin", "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))
                 .select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"), (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"),
                         "count", (F.col("count") / F.lit(max(n, 1) * width)).alias("density")))


def best_step(df: DataFrame, group_col: str, step_col: str, value_col: str,
              greater_is_better: bool = True) -> DataFrame:
    """The step whose metric is best per metric name; the first step on ties."""
    v = F.col(value_col) if greater_is_better else -F.col(value_col)
    pick = F.max_by(F.struct(F.col(step_col).alias("s"), F.col(value_col).alias("v")),
                    F.struct(v, -F.col(step_col)))
    return df.groupBy(group_col).agg(pick.alias("b")).select(
        group_col, F.col("b.s").alias("best_step"), F.col("b.v").alias("best_value"))


def speed_metrics(df: DataFrame, group_cols: Sequence[str], ts_col: str, total_batch: int) -> DataFrame:
    """Runtime, samples per second and steps = ceil(samples / total batch)."""
    us = F.unix_micros(F.col(ts_col).cast("timestamp"))
    g = df.groupBy(*group_cols).agg(((F.max(us) - F.min(us)) / 1e6).alias("runtime"),
                                    F.count(F.lit(1)).alias("n_samples"))
    return g.select(*group_cols, "runtime", "n_samples",
                    F.when(F.col("runtime") > 0, F.col("n_samples") / F.col("runtime")).alias("samples_per_second"),
                    F.ceil(F.col("n_samples") / F.lit(total_batch)).cast("long").alias("steps"))
