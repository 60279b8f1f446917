"""Similarity, retrieval and loss operators over vector tables.

All-pairs work goes through ``plans.blocks.block_pairs``: a block of scores is computed in numpy
inside one task and only per-row reductions leave it. Against a small candidate side the queries are
not moved at all; against a large one the per-block results are merged per query.

A vector without direction (null, or zero where vectors are normalised) has no scores: such a query keeps
its row with null results and counts as a miss, such a candidate is never ranked.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..plans import blocks as B
from ..plans.indexing import row_index
from ..plans.joins import broadcast_if_small
from ..session import cut_lineage


def _vec(col: str, normalize: bool) -> Column:
    return V.l2_normalize(col) if normalize else V.as_double(col)


def _side(df: DataFrame, id_col: str, vec_col: str, normalize: bool) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), _vec(vec_col, normalize).alias("vec"))


def _without_vector(side: DataFrame, schema: str) -> DataFrame:
    """Queries that cannot be scored: their id and nulls for the other fields of ``schema``."""
    names = [f.split() for f in schema.split(", ")]
    nulls = [F.lit(None).cast(kind).alias(name) for name, kind in names if name != "q_id"]
    return side.filter(F.col("vec").isNull()).select(F.col("id").alias("q_id"), *nulls)


def _lse(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Merge (best_id, m, s) parts into one row per key: best_id, best_score, lse."""
    gm = F.max("m").over(Window.partitionBy(*keys))
    return (parts.withColumn("gm", gm).groupBy(*keys)
                 .agg(F.max_by("best_id", F.struct(F.col("m"), -F.col("best_id"))).alias("best_id"), F.first("gm").alias("best_score"),
                      F.log(F.sum(F.col("s") * F.exp(F.col("m") - F.col("gm")))).alias("_l"))
                 .select(*keys, "best_id", "best_score", (F.col("best_score") + F.col("_l")).alias("lse")))


def similarity(queries: DataFrame, cands: DataFrame, *, q_id: str, q_vec: str, c_id: str, c_vec: str,
               scale: float = 1.0, normalize: bool = True, block_rows: int | None = None) -> DataFrame:
    """The scaled similarity matrix, summarised per query row.

    Returns ``q_id, best_id, best_score, lse``: the arg-max candidate (first
    id on ties), its score and the log-sum-exp of the row (softmax
    normaliser). ``similarity_both`` gives both directions in one pass.
    """
    q, c = _side(queries, q_id, q_vec, normalize), _side(cands, c_id, c_vec, normalize)
    parts, whole = B.block_pairs(q, c, B.summary_kernel(scale), B.SUMMARY_SCHEMA, block_rows=block_rows, unscored=True)
    if whole:
        return parts.select("q_id", "best_id", F.col("m").alias("best_score"), (F.col("m") + F.log("s")).alias("lse"))
    out = _lse(parts, ["q_id"])
    return out.unionByName(_without_vector(q, "q_id long, best_id long, best_score double, lse double"))


def similarity_both(pairs: DataFrame, *, id_col: str, a_vec: str, b_vec: str, scale: float = 1.0,
                    normalize: bool = True, block_rows: int | None = None) -> DataFrame:
    """J2 in both directions from one scoring pass: ``side`` 0 = a against all b, 1 = b against all a."""
    a, b = _side(pairs, id_col, a_vec, normalize), _side(pairs, id_col, b_vec, normalize)
    parts, _ = B.block_pairs(a, b, B.summary_kernel(scale, both=True), B.SUMMARY_SCHEMA, block_rows=block_rows)
    out = _lse(parts, ["side", "q_id"])
    lost = [_without_vector(s, "q_id long, best_id long, best_score double, lse double").withColumn("side", F.lit(i)) for i, s in enumerate((a, b))]
    return out.unionByName(lost[0]).unionByName(lost[1])


def top_k(queries: DataFrame, cands: DataFrame, k: int, *, q_id: str, q_vec: str, c_id: str, c_vec: str,
          scale: float = 1.0, normalize: bool = True, block_rows: int | None = None) -> DataFrame:
    """The ``k`` best candidates per query, ``rank`` 1..k (score desc, id asc).

    A query without a vector has one row of nulls.
    """
    q, c = _side(queries, q_id, q_vec, normalize), _side(cands, c_id, c_vec, normalize)
    parts, whole = B.block_pairs(q, c, B.topk_kernel(k, scale), B.TOPK_SCHEMA, block_rows=block_rows, unscored=True)
    if whole:
        return parts
    # Spark keeps k rows of a query in each task before this shuffle, so a query's group is k x tasks
    w = Window.partitionBy("q_id").orderBy(F.desc("score"), F.asc("c_id"))
    parts = parts.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
    return parts.select("q_id", "rank", "c_id", "score").unionByName(_without_vector(q, B.TOPK_SCHEMA))


def top_k_softmax(queries: DataFrame, cands: DataFrame, k: int, *, q_id: str, q_vec: str, c_id: str,
                  c_vec: str, scale: float = 1.0, normalize: bool = True, block_rows: int | None = None) -> DataFrame:
    """W1 + W2 in one scoring pass: the k best candidates with their softmax probability
    over *all* candidates (``q_id, rank, c_id, score, prob``). A query without a vector has one row of nulls.
    """
    q, c = _side(queries, q_id, q_vec, normalize), _side(cands, c_id, c_vec, normalize)
    parts, whole = B.block_pairs(q, c, B.topk_lse_kernel(k, scale), B.TOPK_LSE_SCHEMA, block_rows=block_rows, unscored=True)
    if whole:  # one part per query: its rows already carry the normaliser
        top = parts.withColumn("lse", F.col("m") + F.log("s"))
    else:
        parts = cut_lineage(parts, "top-k-parts")
        norm = parts.filter(F.col("rank") == 1).select("q_id", F.col("c_id").alias("best_id"), "m", "s")
        w = Window.partitionBy("q_id").orderBy(F.desc("score"), F.asc("c_id"))
        top = parts.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
        top = top.join(_lse(norm, ["q_id"]).select("q_id", "lse"), "q_id")
    out = top.select("q_id", "rank", "c_id", "score", F.exp(F.col("score") - F.col("lse")).alias("prob"))
    return out if whole else out.unionByName(_without_vector(q, "q_id long, rank long, c_id long, score double, prob double"))


def _dense_kernel(scale: float):
    def kern(q: B.Side, c: B.Side) -> pd.DataFrame:
        s = (q.vecs @ c.vecs.T) * scale
        ids = c.ids.tolist()
        return pd.DataFrame({"q_id": q.ids, "c_ids": [ids] * len(q), "scores": list(s)})
    return kern


def dense_scores(queries: DataFrame, cands: DataFrame, *, q_id: str, q_vec: str, c_id: str, c_vec: str,
                 scale: float = 1.0, normalize: bool = True, block_rows: int | None = None) -> DataFrame:
    """Per query, the score against every candidate as one array in candidate-id order.

    The output row is as wide as the candidate side (classes, a vocabulary, the rows of a projection
    matrix); a side too large to ship is scored in blocks whose pieces are put together per query.
    """
    c, q = _side(cands, c_id, c_vec, normalize), _side(queries, q_id, q_vec, normalize)
    parts, whole = B.block_pairs(q, c, _dense_kernel(scale), "q_id long, c_ids array<long>, scores array<double>", block_rows=block_rows,
                                 unscored=True)
    if whole:
        return parts
    flat = parts.select("q_id", F.arrays_zip(F.col("c_ids").alias("c"), F.col("scores").alias("s")).alias("z"))
    parts = (flat.groupBy("q_id").agg(F.sort_array(F.flatten(F.collect_list("z"))).alias("z"))
                 .select("q_id", F.transform("z", lambda e: e["c"]).alias("c_ids"), F.transform("z", lambda e: e["s"]).alias("scores")))
    return parts.unionByName(_without_vector(q, "q_id long, c_ids array<long>, scores array<double>"))


def softmax(queries: DataFrame, cands: DataFrame, *, q_id: str, q_vec: str, c_id: str, c_vec: str,
            scale: float = 100.0, normalize: bool = True, block_rows: int | None = None) -> DataFrame:
    """Per query, probabilities over the candidate set, candidate-id order."""
    d = dense_scores(queries, cands, q_id=q_id, q_vec=q_vec, c_id=c_id, c_vec=c_vec,
                     scale=scale, normalize=normalize, block_rows=block_rows)
    return d.select("q_id", "c_ids", softmax_array("scores").alias("probs"))


def softmax_array(scores) -> Column:
    """exp(x - max) / sum(exp(x - max)) over an array column."""
    s = F.col(scores) if isinstance(scores, str) else scores
    m = F.array_max(s)
    e = F.transform(s, lambda x: F.exp(x - m))
    tot = F.aggregate(e, F.lit(0.0).cast("double"), lambda a, x: a + x)
    return F.transform(e, lambda x: x / tot)


def project(df: DataFrame, matrix: DataFrame, *, id_col: str, vec_col: str, row_col: str, row_vec: str,
            bias: list[float] | None = None, block_rows: int | None = None) -> DataFrame:
    """``out[j] = sum_i vec[i] * matrix[j][i] (+ bias[j])`` for every vector.

    ``matrix`` holds one output dimension per row (``row_col`` gives the output position).
    """
    d = dense_scores(df, matrix, q_id=id_col, q_vec=vec_col, c_id=row_col, c_vec=row_vec,
                     scale=1.0, normalize=False, block_rows=block_rows)
    out = d.select(F.col("q_id").alias(id_col), F.col("scores").alias("projected"))
    if bias is not None:
        b = F.array(*[F.lit(float(x)) for x in bias])
        out = out.select(id_col, F.zip_with("projected", b, lambda x, y: x + y).alias("projected"))
    return out


def apply_map(df: DataFrame, weights: DataFrame, *, id_col: str, vec_col: str) -> DataFrame:
    """A solved map (i, j, w) applied through X15: ``out[j] = sum_i vec[i] * w[i, j]``."""
    columns = (weights.groupBy("j").agg(F.sort_array(F.collect_list(F.struct("i", "w"))).alias("iw"))
                      .select("j", F.transform("iw", lambda e: e["w"]).alias("row")))
    return project(df, columns, id_col=id_col, vec_col=vec_col, row_col="j", row_vec="row")


def nearest_entry(vecs: DataFrame, vocab: DataFrame, *, q_id: str, q_vec: str, c_id: str, c_vec: str) -> DataFrame:
    """The vocabulary row with the largest inner product (first id on ties)."""
    s = similarity(vecs, vocab, q_id=q_id, q_vec=q_vec, c_id=c_id, c_vec=c_vec, scale=1.0, normalize=False)
    return s.select("q_id", F.col("best_id").alias("nearest_id"), F.col("best_score").alias("score"))


def truth_rank(queries: DataFrame, cands: DataFrame, *, q_id: str, q_vec: str, truth_id: str,
               c_id: str, c_vec: str, normalize: bool = True, block_rows: int | None = None) -> DataFrame:
    """Rank of each query's true candidate: 1 + candidates scored above it; null without truth or vector.

    Counting replaces sorting, so no per-query candidate list is built.
    """
    c = _side(cands, c_id, c_vec, normalize)
    q = queries.select(F.col(q_id).cast("long").alias("qid"), _vec(q_vec, normalize).alias("qvec"), F.col(truth_id).cast("long").alias("tid"))
    # the true candidate's vector travels with its query (equi-join on id)
    q = q.join(c.select(F.col("id").alias("tid"), F.col("vec").alias("tvec")), "tid", "left")
    parts, _ = B.block_pairs(q, c, B.better_count_kernel(1.0), B.BETTER_SCHEMA, q_id="qid", q_vec="qvec",
                             q_aux=("tid", "tvec"), block_rows=block_rows)
    ranks = parts.groupBy("q_id").agg((F.sum("n_better") + 1).cast("long").alias("rank"))
    lost = q.filter(F.col("qvec").isNull() | F.col("tvec").isNull()).select(F.col("qid").alias("q_id"), F.lit(None).cast("long").alias("rank"))
    return ranks.unionByName(lost)


def pair_ranks(pairs: DataFrame, *, id_col: str, a_vec: str, b_vec: str, normalize: bool = True,
               block_rows: int | None = None) -> DataFrame:
    """Ranks of matched pairs in both directions from one scoring pass: side, q_id, rank (null without both vectors)."""
    p = pairs.select(F.col(id_col).cast("long").alias("id"), _vec(a_vec, normalize).alias("a"), _vec(b_vec, normalize).alias("b"))
    full = p.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    # A side without its match still competes with the others' truths: it is scored against, not ranked.
    half = F.coalesce("b", F.transform("a", lambda x: F.lit(0.0)))
    other = F.coalesce("a", F.transform("b", lambda x: F.lit(0.0)))
    q = p.filter(F.col("a").isNotNull()).select("id", "a", half.alias("t"))
    c = p.filter(F.col("b").isNotNull()).select("id", "b", other.alias("t"))
    parts, _ = B.block_pairs(q, c, B.better_count_kernel(1.0, both=True), B.BETTER_SCHEMA, q_vec="a", c_vec="b",
                             q_aux=("id", "t"), c_aux=("id", "t"), block_rows=block_rows)
    ranks = parts.groupBy("side", "q_id").agg((F.sum("n_better") + 1).cast("long").alias("rank"))
    ranks = ranks.join(full.select(F.col("id").alias("q_id")), "q_id", "left_semi")
    sides = F.explode(F.array(F.lit(0), F.lit(1)))
    lost = p.filter(F.col("a").isNull() | F.col("b").isNull()).select(sides.alias("side"), F.col("id").alias("q_id"), F.lit(None).cast("long").alias("rank"))
    return ranks.unionByName(lost)


def _hit(k: int) -> Column:
    """1 where the rank is at most k; a missing rank is a miss."""
    return F.coalesce(F.col("rank") <= k, F.lit(False)).cast("double")


def recall_at_k(ranks: DataFrame, ks=(1, 5, 10)) -> DataFrame:
    """A15 from a rank table: one row per k with the share of ranks <= k."""
    aggs = [F.avg(_hit(k)).alias(f"r{k}") for k in ks]
    return ranks.agg(*aggs)


def retrieval_report(pairs: DataFrame, *, id_col: str, a_vec: str, b_vec: str, a_name: str = "text",
                     b_name: str = "image", ks=(1, 5, 10)) -> DataFrame:
    """recall@k in both directions plus their mean as (name, value) rows.

    One scoring pass gives both directions; the mean is a window over those two rows.
    """
    ranks = pair_ranks(pairs, id_col=id_col, a_vec=a_vec, b_vec=b_vec)
    names = F.when(F.col("side") == 0, F.lit(f"{a_name}_to_{b_name}")).otherwise(F.lit(f"{b_name}_to_{a_name}"))
    per = ranks.groupBy(names.alias("d")).agg(*[F.avg(_hit(k)).alias(f"r{k}") for k in ks])
    per = per.withColumn("mean", F.avg(sum(F.col(f"r{k}") for k in ks) / len(ks)).over(Window.partitionBy()))
    first = F.col("d") == F.lit(f"{a_name}_to_{b_name}")
    entries = [F.struct(F.concat(F.col("d"), F.lit(f"_r{k}")).alias("name"), F.col(f"r{k}").alias("value"))
               for k in ks]
    entries.append(F.when(first, F.struct(F.lit("mean_recall").alias("name"), F.col("mean").alias("value"))))
    return (per.select(F.explode(F.array(*entries)).alias("m")).filter(F.col("m").isNotNull())
               .select("m.name", "m.value"))


def zero_shot_accuracy(vecs: DataFrame, classes: DataFrame, *, id_col: str, vec_col: str, label_col: str,
                       class_col: str, class_vec: str, ks=(1, 5)) -> DataFrame:
    """Share of vectors whose label is among the top-k classes; a vector without direction is a miss."""
    t = top_k(vecs, classes, max(ks), q_id=id_col, q_vec=vec_col, c_id=class_col, c_vec=class_vec)
    lab = vecs.select(F.col(id_col).cast("long").alias("q_id"), F.col(label_col).cast("long").alias("lab"))
    hit = t.join(lab, "q_id").withColumn("hit", F.coalesce(F.col("c_id") == F.col("lab"), F.lit(False)))
    per = hit.groupBy("q_id").agg(*[F.max(F.when(F.col("rank") <= k, F.col("hit")).otherwise(False))
                                   .cast("double").alias(f"top{k}") for k in ks])
    return per.agg(*[F.avg(f"top{k}").alias(f"top{k}") for k in ks])


def contrastive_loss(queries: DataFrame, cands: DataFrame, *, q_id: str, q_vec: str, c_id: str, c_vec: str,
                     scale: float = 100.0, normalize: bool = True) -> DataFrame:
    """A5: mean over query rows of -log softmax at the matching candidate (same id)."""
    s = similarity(queries, cands, q_id=q_id, q_vec=q_vec, c_id=c_id, c_vec=c_vec, scale=scale,
                   normalize=normalize)
    qv = V.l2_normalize(q_vec) if normalize else V.as_double(q_vec)
    cv = V.l2_normalize(c_vec) if normalize else V.as_double(c_vec)
    diag = (queries.select(F.col(q_id).cast("long").alias("q_id"), qv.alias("qv"))
                   .join(cands.select(F.col(c_id).cast("long").alias("q_id"), cv.alias("cv")), "q_id")
                   .select("q_id", (V.dot("qv", "cv") * F.lit(scale)).alias("diag")))
    return s.join(diag, "q_id").agg(F.avg(F.col("lse") - F.col("diag")).alias("loss"))


def contrastive_loss_sym(pairs: DataFrame, *, id_col: str, a_vec: str, b_vec: str,
                         scale: float = 100.0) -> DataFrame:
    """Mean of both directions."""
    both = similarity_both(pairs, id_col=id_col, a_vec=a_vec, b_vec=b_vec, scale=scale)
    diag = pairs.select(F.col(id_col).cast("long").alias("q_id"), (V.cosine(a_vec, b_vec) * F.lit(scale)).alias("diag"))
    row = both.join(diag, "q_id").withColumn("l", F.col("lse") - F.col("diag"))
    sides = row.agg(*[F.avg(F.when(F.col("side") == i, F.col("l"))).alias(n) for i, n in enumerate(("loss_a_to_b", "loss_b_to_a"))])
    return sides.select(((F.col("loss_a_to_b") + F.col("loss_b_to_a")) / 2).alias("loss"), "loss_a_to_b", "loss_b_to_a")


def _tile(a: pd.DataFrame, b: pd.DataFrame, scale: float) -> pd.DataFrame:
    """Rows of one tile of a batch against those of another: log-sum-exp and how many outrank the match (``diag``).

    Rows stand in the order of ``at``; an equal score outranks the match from an earlier place. The match itself is
    known by its place. A gap below ``TIE_EPS`` ties, since products of other shapes sum in another order.
    """
    s = (B.as_matrix(a.a) @ B.as_matrix(b.b).T) * scale
    m = s.max(axis=1)
    diag, at, other = a["diag"].to_numpy()[:, None], a["at"].to_numpy()[:, None], b["at"].to_numpy()[None, :]
    tie = np.abs(s - diag) <= B.TIE_EPS * np.maximum(1.0, np.abs(diag))
    better = (((s > diag) & ~tie) | (tie & (other < at))) & (other != at)
    return a[["none", "batch_id", "id", "at", "diag", "size"]].assign(lse=m + np.log(np.exp(s - m[:, None]).sum(axis=1)), better=better.sum(axis=1))


def _batch_rows(scale: float):
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(at=np.arange(len(pdf)), size=len(pdf))
        out = _tile(pdf, pdf, scale)
        return out.assign(rank=out.better + 1)[["none", "batch_id", "id", "lse", "diag", "rank", "size"]]

    def run(it):
        """Batches lie one after another in a partition; an Arrow batch holds many, its last may go on in the next."""
        held = None
        for pdf in it:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            open_batch = (pdf.none == pdf.none.iloc[-1]) & (pdf.batch_id == pdf.batch_id.iloc[-1])
            held = pdf[open_batch]
            done = [one(g) for _, g in pdf[~open_batch].groupby(["none", "batch_id"], sort=False)]
            if done:
                yield pd.concat(done, ignore_index=True)
        if held is not None:
            yield one(held)

    return run


def _tiled_batches(rows: DataFrame, scale: float, tile_rows: int) -> DataFrame:
    """Batches (with their ``size``) cut into tiles of ``tile_rows``: every pair of tiles is a group of its own.

    A row travels once per tile of its batch, the scores of a pair stay in its task, and a row's parts (one
    per tile) are merged by their log-sum-exps.
    """
    placed = row_index(rows, ["id", "h"], partition_by=["none", "batch_id"], name="at", start=0)
    tiles = F.ceil(F.col("size") / tile_rows).cast("int")
    placed = placed.withColumns({"tile": F.floor(F.col("at") / tile_rows).cast("int"), "other": F.explode(F.sequence(F.lit(0), tiles - 1))})
    left = placed.select("none", "batch_id", F.col("tile").alias("ti"), F.col("other").alias("tj"), "id", "at", "diag", "size", "a", F.lit(None).cast("array<double>").alias("b"))
    right = placed.select("none", "batch_id", F.col("other").alias("ti"), F.col("tile").alias("tj"), "id", "at", "diag", "size", F.lit(None).cast("array<double>").alias("a"), "b")

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        of_left = pdf.a.notna()
        return _tile(pdf[of_left], pdf[~of_left], scale)

    parts = (left.unionByName(right).groupBy("none", "batch_id", "ti", "tj")
             .applyInPandas(pair, "none boolean, batch_id long, id long, at long, diag double, size long, lse double, better long"))
    merged = parts.groupBy("none", "batch_id", "id", "at", "diag", "size").agg(F.collect_list("lse").alias("ls"), (F.sum("better") + 1).alias("rank"))
    top = F.array_max("ls")
    lse = top + F.log(F.aggregate("ls", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.array_max("ls"))))
    return merged.select("none", "batch_id", "id", lse.alias("lse"), "diag", "rank", "size")


def in_batch_pairs(df: DataFrame, *, batch_col: str, id_col: str, a_vec: str, b_vec: str,
                   scale: float = 100.0, normalize: bool = True, tile_rows: int = 2048) -> DataFrame:
    """Every row against every row of its batch, whatever the batch's size.

    Returns per row: the row's log-sum-exp over the batch, its matched score
    (diag), the rank of the match inside the batch and the batch's size. Rows without both vectors
    stand outside their batch, with nulls. Rows without a batch are one batch. Rows that repeat an id are ordered by a hash of their vectors.

    Batches of at most ``tile_rows`` rows share Arrow calls; a larger one is scored in pairs of tiles in many tasks.
    """
    x = df.select(F.col(batch_col).cast("long").alias("batch_id"), F.col(id_col).cast("long").alias("id"),
                  _vec(a_vec, normalize).alias("a"), _vec(b_vec, normalize).alias("b"))
    full = F.col("a").isNotNull() & F.col("b").isNotNull()
    schema = "batch_id long, id long, lse double, diag double, rank long, size long"
    batch = ["none", "batch_id"]  # whole numbers only: pandas would hold a column with nulls as floats
    rows = x.filter(full).withColumns({"none": F.col("batch_id").isNull(), "batch_id": F.coalesce("batch_id", F.lit(0)),
                                       "diag": V.dot("a", "b") * F.lit(scale), "h": F.xxhash64("a", "b")})
    sizes = rows.groupBy(*batch).agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > tile_rows)
    large, n_large = broadcast_if_small(cut_lineage(sizes, "large-batches"), row_bytes=24)
    small = rows.join(large, batch, "left_anti") if n_large else rows
    small = small.repartition(*batch).sortWithinPartitions(*batch, "id", "h").select(*batch, "id", "a", "b", "diag")
    out = small.mapInPandas(_batch_rows(scale), f"none boolean, {schema}")
    if n_large:
        out = out.unionByName(_tiled_batches(rows.join(large, batch), scale, tile_rows))
    out = out.withColumn("batch_id", F.when(~F.col("none"), F.col("batch_id"))).drop("none")
    lost = x.filter(~full).select("batch_id", "id", *[F.lit(None).cast(k).alias(n) for n, k in (f.split() for f in schema.split(", ")[2:])])
    return out.unionByName(lost)


def masked_cross_entropy(logits_src: DataFrame, classes: DataFrame, *, id_col: str, vec_col: str,
                         label_col: str, class_col: str, class_vec: str, ignore: int = -100) -> DataFrame:
    """Mean token cross-entropy of logits = vec . class_vec; label ``ignore`` skipped."""
    keep = logits_src.filter(F.col(label_col) != ignore)
    s = similarity(keep, classes, q_id=id_col, q_vec=vec_col, c_id=class_col, c_vec=class_vec,
                   scale=1.0, normalize=False)
    cls = classes.select(F.col(class_col).cast("long").alias("lab"), V.as_double(class_vec).alias("cv"))
    width = cls.agg(F.max(F.size("cv"))).first()[0] or 1
    cls, _ = broadcast_if_small(cls, row_bytes=8 * width + 16, max_bytes=B.BROADCAST_BYTES)
    tgt = (keep.select(F.col(id_col).cast("long").alias("q_id"), F.col(label_col).cast("long").alias("lab"),
                       V.as_double(vec_col).alias("v"))
               .join(cls, "lab").select("q_id", V.dot("v", "cv").alias("logit")))
    return s.join(tgt, "q_id").agg(F.avg(F.col("lse") - F.col("logit")).alias("loss"),
                                   F.count(F.lit(1)).alias("n_tokens"))


#: Rows a task holds before it reduces them to a triangle again.
QR_ROWS = 8192
#: Tasks that reduce the triangles of all tasks, step by step.
QR_STEPS = (64, 8, 1)


def _triangle(it):
    """Rows (v) to the triangle of their QR decomposition: at most as many rows as columns, with the same products."""
    held, d = None, 0
    for pdf in it:
        if not len(pdf):
            continue
        d, rows = int(pdf.d.iloc[0]), B.as_matrix(pdf.v)
        held = rows if held is None else np.vstack([held, rows])
        if len(held) >= max(QR_ROWS, 2 * held.shape[1]):
            held = np.linalg.qr(held, mode="r")
    if held is not None:
        yield pd.DataFrame({"d": d, "v": list(np.linalg.qr(held, mode="r"))})


def map_triangle(df: DataFrame, x_col: str, y_col: str) -> DataFrame:
    """A19 (distributed part): rows (d, v) with the same products as the rows [x | y]; ``d`` is the width of x.

    A tall table's QR decomposition: every task reduces its rows to a triangle (one vector a row, no
    row per element), and the triangles are again rows, reduced by fewer and fewer tasks. Rows without both vectors are left out.
    """
    x, y = V.as_double(x_col), V.as_double(y_col)
    rows = df.select(x.alias("x"), y.alias("y")).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    rows = rows.select(F.size("x").alias("d"), F.concat("x", "y").alias("v"))
    for tasks in (None, *QR_STEPS):
        rows = (rows.repartition(tasks) if tasks else rows).mapInPandas(_triangle, "d int, v array<double>")
    return rows


def _products(it):
    for pdf in it:
        if not len(pdf):
            continue
        d, r = int(pdf.d.iloc[0]), B.as_matrix(pdf.v)
        for kind, m in (("xtx", r[:, :d].T @ r[:, :d]), ("xty", r[:, :d].T @ r[:, d:])):
            i, j = np.indices(m.shape).reshape(2, -1)
            yield pd.DataFrame({"kind": kind, "i": i, "j": j, "v": m.ravel()})


def gram_sums(df: DataFrame, x_col: str, y_col: str) -> DataFrame:
    """X^T X and X^T Y as (kind, i, j, v), from the one triangle of all rows."""
    return map_triangle(df, x_col, y_col).mapInPandas(_products, "kind string, i long, j long, v double")


def fit_linear_map(df: DataFrame, x_col: str, y_col: str, ridge: float = 0.0) -> DataFrame:
    """Least-squares W with X W ~ Y as a table (i, j, w); the smallest W where several fit.

    Solved on the triangle, not on X^T X, whose condition is the square of X's. Only the triangle reaches the
    driver: one vector for each of its columns. An empty table gives an empty map.
    """
    rows = map_triangle(df, x_col, y_col).collect()
    d = rows[0].d if rows else 0
    r = np.array([row.v for row in rows]) if rows else np.zeros((0, 0))
    e = r.shape[1] - d
    x, y = r[:, :d], r[:, d:]
    if ridge:
        x, y = np.vstack([x, np.sqrt(ridge) * np.eye(d)]), np.vstack([y, np.zeros((d, e))])
    w = np.linalg.lstsq(x, y, rcond=None)[0] if rows else np.zeros((0, 0))
    table = pd.DataFrame({"i": np.repeat(np.arange(d), e), "j": np.tile(np.arange(e), d), "w": w.ravel()})
    return df.sparkSession.createDataFrame(table, "i long, j long, w double")
