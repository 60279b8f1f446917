"""Exact top-k by cosine against a large candidate side, without scoring all pairs.

Candidates belong to their nearest pivot (a hash-selected sample of them) and lie in blocks of bounded size by their angle
to it. By the triangle inequality of angles a candidate is at least ``|angle(query, pivot) - angle(candidate, pivot)|``
away, so a block's range of angles bounds its best score. Each query first visits the blocks of best bound that hold
``k`` candidates; its k-th score then rules out every block whose bound lies below. Blocks lie on shelves: a query goes once
to each shelf with a block that is still open, and is scored there on the open blocks alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..plans import blocks as B
from ..plans.indexing import row_index
from ..session import cut_lineage

#: Pivots at most (their vectors go to every task), candidates per pivot, and rows of a block.
MAX_PIVOTS, PER_PIVOT, BLOCK_ROWS = 1_024, 64, 4_096
#: Candidates of a shelf (or one block, if that has more), and queries of a place beside it.
SHELF_ROWS = 16_384
#: Cells (8 bytes each) of a table of bounds or scores at once.
CELLS = 1024 * 1024
#: Blocks whose bounds may go to every task (32 bytes each).
MAX_BLOCKS = 1_000_000
#: Rounding error of an angle, on the safe side.
SLACK = 1e-6
DIGITS = 12


class Bounds:
    """Pivots and blocks, as every task holds them."""

    def __init__(self, pivots: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, rows: np.ndarray):
        self.pivots, self.of, self.low, self.high, self.rows = pivots, of, low, high, rows

    def angles(self, vecs: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(vecs @ self.pivots.T, -1, 1))

    def best(self, vecs: np.ndarray) -> np.ndarray:
        """The score that no candidate of a block exceeds, for each vector and block."""
        angle = self.angles(vecs)[:, self.of]
        return np.cos(np.clip(np.maximum(angle - self.high, self.low - angle) - SLACK, 0, math.pi))

    def first(self, best: np.ndarray, k: int) -> np.ndarray:
        """Whether a block is one of the best that together hold ``k`` candidates."""
        order = np.argsort(-best, axis=1, kind="stable")
        held = np.cumsum(self.rows[order], axis=1)
        chosen = np.zeros(best.shape, bool)
        np.put_along_axis(chosen, order, np.c_[np.zeros(len(best), np.int64), held[:, :-1]] < k, axis=1)
        return chosen


def _kernel(k: int):
    """Best ``k`` candidates of a block. Scores are cut to ``DIGITS``, so that equal vectors tie in whatever block they lie."""

    def kern(q: B.Side, c: B.Side) -> pd.DataFrame:
        s = np.round(q.vecs @ c.vecs.T, DIGITS)
        rows, cols = B._best(s, k)
        return pd.DataFrame({"q_id": q.ids[rows], "rank": np.arange(len(rows)) % min(k, s.shape[1]) + 1, "c_id": c.ids[cols], "score": s[rows, cols]})

    return kern


def _visits(queries: DataFrame, shared, k: int) -> DataFrame:
    """(id, vec, block): the first blocks of each query, a row for each."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bounds = Bounds(*shared.value)
        step = max(1, CELLS // max(1, len(bounds.of)))
        for whole in it:
            for at in range(0, len(whole), step):
                pdf = whole.iloc[at: at + step]
                row, block = np.nonzero(bounds.first(bounds.best(B.as_matrix(pdf["vec"].to_numpy())), k))
                yield pd.DataFrame({"id": pdf["id"].to_numpy()[row], "vec": pdf["vec"].to_numpy()[row], "block": block})

    return queries.mapInPandas(run, "id long, vec array<double>, block long")


def _shelf_visits(queries: DataFrame, shared, shelf_of: np.ndarray) -> DataFrame:
    """(id, vec, least, block): the shelves that hold a block which a query's k-th score ``least`` does not rule out, a row for each."""
    starts = np.flatnonzero(np.r_[True, np.diff(shelf_of) != 0])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bounds = Bounds(*shared.value)
        step = max(1, CELLS // max(1, len(bounds.of)))
        for whole in it:
            for at in range(0, len(whole), step):
                pdf = whole.iloc[at: at + step]
                open_blocks = bounds.best(B.as_matrix(pdf["vec"].to_numpy())) >= pdf["least"].fillna(-np.inf).to_numpy()[:, None]
                row, shelf = np.nonzero(np.logical_or.reduceat(open_blocks, starts, axis=1))
                yield pd.DataFrame({"id": pdf["id"].to_numpy()[row], "vec": pdf["vec"].to_numpy()[row], "least": pdf["least"].to_numpy()[row], "block": shelf})

    return queries.mapInPandas(run, "id long, vec array<double>, least double, block long")


def _dealt(visits: DataFrame, cands: DataFrame, rows: int) -> DataFrame:
    """Both sides of each block in one table. The queries of a block are dealt to as many places of ``rows`` as their number asks for."""
    places = visits.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("int").alias("places"))
    nothing = {"least": F.lit(None).cast("double"), "part_of": F.lit(None).cast("long")}
    fill = lambda df: [F.col(n) if n in df.columns else x.alias(n) for n, x in nothing.items()]
    qs = visits.join(places, "block").select("block", F.pmod(F.xxhash64("id"), F.col("places")).cast("int").alias("place"), F.lit(0).alias("side"), "id", "vec", *fill(visits))
    cs = cands.join(places, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"), F.lit(1).alias("side"), "id", "vec", *fill(cands))
    return qs.unionByName(cs).groupBy("block", "place")


def _scored(visits: DataFrame, cands: DataFrame, kernel) -> DataFrame:
    """Top-k rows of each visit."""
    names = [f.split()[0] for f in B.TOPK_SCHEMA.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q, c = (B.Side(x["id"].to_numpy(np.int64), B.as_matrix(x["vec"].to_numpy())) for x in (pdf[pdf.side == i].sort_values("id", kind="stable") for i in (0, 1)))
        if not len(q) or not len(c):
            return pd.DataFrame({n: [] for n in names})
        step = max(1, CELLS // len(c))
        return pd.concat([kernel(q.part(at, step), c) for at in range(0, len(q), step)], ignore_index=True)

    return _dealt(visits, cands, BLOCK_ROWS).applyInPandas(run, B.TOPK_SCHEMA)


def _top(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``k`` cells of each row: score desc, id asc."""
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    starts = np.flatnonzero(np.r_[True, np.diff(rows) != 0]) if len(rows) else np.zeros(0, np.int64)
    keep = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)])) < k
    return rows[keep], ids[keep], scores[keep]


def _shelves_scored(visits: DataFrame, cands: DataFrame, shared, k: int) -> DataFrame:
    """Top-k rows of each query on each of its shelves, and a row without ``q_id`` that tells how many ``pairs`` a group scored.

    A group holds the blocks of a shelf and some of its queries, and scores a query only on the blocks that its k-th
    score does not rule out; only scores that reach it are kept. So a vector moves once a shelf, not once a block.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q, c = (pdf[pdf.side == i].sort_values("id", kind="stable") for i in (0, 1))
        if not len(q) or not len(c):
            return pd.DataFrame({n: [] for n in names})
        bounds = Bounds(*shared.value)
        vecs, least, ids = B.as_matrix(q["vec"].to_numpy()), q["least"].fillna(-np.inf).to_numpy(), q["id"].to_numpy(np.int64)
        of = c["part_of"].to_numpy(np.int64)
        order = np.argsort(of, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(of[order]) != 0, True])
        numbers = of[order][edges[:-1]]
        c_ids, c_vecs = c["id"].to_numpy(np.int64)[order], B.as_matrix(c["vec"].to_numpy())[order]
        pairs, found = 0, [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        open_blocks = np.zeros((len(q), len(numbers)), bool)
        step = max(1, CELLS // max(1, len(bounds.of)))
        for at in range(0, len(q), step):
            open_blocks[at: at + step] = bounds.best(vecs[at: at + step])[:, numbers] >= least[at: at + step, None]
        for i in range(len(numbers)):
            block = slice(edges[i], edges[i + 1])
            asking, width = np.flatnonzero(open_blocks[:, i]), edges[i + 1] - edges[i]
            pairs += len(asking) * int(width)
            for rows in np.split(asking, range(step := max(1, CELLS // int(width)), len(asking), step)):
                s = np.round(vecs[rows] @ c_vecs[block].T, DIGITS)
                some = np.flatnonzero(s.max(axis=1, initial=-np.inf) >= least[rows])
                row, col = B._best(s[some], k) if len(some) else (some, some)
                score = s[some[row], col]
                kept = score >= least[rows[some[row]]]
                found.append((rows[some[row[kept]]], c_ids[block][col[kept]], score[kept]))
            if sum(len(x[0]) for x in found) > CELLS:
                found = [_top(*map(np.concatenate, zip(*found, strict=True)), k)]
        row, other, score = _top(*map(np.concatenate, zip(*found, strict=True)), k)
        out = pd.DataFrame({"q_id": pd.array(ids[row], "Int64"), "c_id": pd.array(other, "Int64"), "score": score, "pairs": 0})
        return pd.concat([out, pd.DataFrame({"q_id": pd.array([None], "Int64"), "c_id": pd.array([None], "Int64"), "score": [0.0], "pairs": [pairs]})], ignore_index=True)

    names = ["q_id", "c_id", "score", "pairs"]
    return _dealt(visits, cands, SHELF_ROWS).applyInPandas(run, "q_id long, c_id long, score double, pairs long")


def _kept(parts: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q_id").orderBy(F.desc("score"), F.asc("c_id"))  # k rows a visit
    return parts.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def top_k_pruned(queries: DataFrame, cands: DataFrame, k: int, *, q_id: str, q_vec: str, c_id: str, c_vec: str, scale: float = 1.0,
                 block_rows: int = BLOCK_ROWS, per_pivot: int = PER_PIVOT) -> tuple[DataFrame, float]:
    """The rows of ``top_k`` on normalised vectors (q_id, rank, c_id, score), and the share of all pairs in blocks that the
    k-th scores leave open: these are scored, those of a query's first blocks a second time.

    A query without a vector has one row of nulls; so has every query where there are no candidates.
    Scores equal to 12 digits tie, the smaller id first. ``scale`` is positive. More than ``MAX_BLOCKS`` blocks are an error: take larger blocks.
    """
    c = cands.select(F.col(c_id).cast("long").alias("id"), V.l2_normalize(c_vec).alias("vec")).where(F.col("vec").isNotNull())
    q = queries.select(F.col(q_id).cast("long").alias("id"), V.l2_normalize(q_vec).alias("vec"))
    lost = q.where(F.col("vec").isNull())
    n = c.count()
    spark, nulls = queries.sparkSession, [F.lit(None).cast(t).alias(x) for x, t in (("rank", "long"), ("c_id", "long"), ("score", "double"))]
    if n == 0:
        return q.select(F.col("id").alias("q_id"), *nulls), 0.0
    n_pivots = max(1, min(MAX_PIVOTS, n // per_pivot))
    if n // block_rows + n_pivots > MAX_BLOCKS:
        raise ValueError("too many blocks for their bounds to be shipped; raise block_rows")
    pivots = B.as_matrix([r.vec for r in c.orderBy(F.xxhash64("id"), "id").limit(n_pivots).collect()])
    held = spark.sparkContext.broadcast(pivots)

    def assign(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                angle = np.arccos(np.clip(B.as_matrix(pdf["vec"].to_numpy()) @ held.value.T, -1, 1))
                near = angle.argmin(axis=1)
                yield pdf.assign(pivot=near, angle=angle[np.arange(len(near)), near])

    placed = row_index(c.mapInPandas(assign, "id long, vec array<double>, pivot long, angle double"), ["angle", "id"], partition_by=["pivot"], name="at", start=0)
    placed = placed.select("id", "vec", "pivot", "angle", F.floor(F.col("at") / block_rows).alias("part"))
    placed = cut_lineage(placed, "candidates")
    stats = placed.groupBy("pivot", "part").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count(F.lit(1)).alias("rows")).toPandas()
    stats = stats.sort_values(["pivot", "part"], ignore_index=True)
    numbers = spark.createDataFrame(stats[["pivot", "part"]].assign(block=np.arange(len(stats))), "pivot long, part long, block long")
    blocks = placed.join(F.broadcast(numbers), ["pivot", "part"]).select("id", "vec", "block")
    shared = spark.sparkContext.broadcast((pivots, *(stats[x].to_numpy() for x in ("pivot", "low", "high", "rows"))))

    whole = cut_lineage(q.where(F.col("vec").isNotNull()), "queries")
    first_visits = cut_lineage(_visits(whole, shared, k), "visits")
    found = cut_lineage(_kept(_scored(first_visits, blocks, _kernel(k)), k), "first-found")
    least = found.where(F.col("rank") == k).select(F.col("q_id").alias("id"), F.col("score").alias("least"))
    # Neighbouring blocks share a shelf. The first blocks are among those that the k-th score leaves open: the second round finds all.
    sizes = stats["rows"].to_numpy()
    _, shelf_of = np.unique((np.cumsum(sizes) - sizes) // SHELF_ROWS, return_inverse=True)
    shelves = spark.createDataFrame(pd.DataFrame({"part_of": np.arange(len(stats)), "shelf": shelf_of}), "part_of long, shelf long")
    shelved = blocks.withColumnRenamed("block", "part_of").join(F.broadcast(shelves), "part_of").withColumnRenamed("shelf", "block")
    visits = cut_lineage(_shelf_visits(whole.join(least, "id", "left"), shared, shelf_of), "shelf-visits")
    more = cut_lineage(_shelves_scored(visits, shelved, shared, k), "found")
    scored = more.agg(F.sum("pairs")).first()[0] or 0
    out = _kept(more.where(F.col("q_id").isNotNull()), k).select("q_id", "rank", "c_id", (F.col("score") * scale).alias("score"))
    return out.unionByName(lost.select(F.col("id").alias("q_id"), *nulls)), scored / max(1, n * whole.count())
