"""All-pairs scoring without materialising pairs.

**Small candidate side** (classes, a vocabulary; its bytes are measured first): the candidates go to every
task as one matrix and the queries stay where they are (``mapInPandas``, no exchange).

**Large candidate side**: queries and candidates are cut into hash blocks of up to ``BLOCK_BYTES``, and
each (query block, candidate block) pair is one ``applyInPandas`` group. A vector of one side is sent to
every block of the other, so tall blocks keep the shuffle small: N x M / block rows.

Either way numpy scores a bounded number of cells at a time and emits only reductions: top-k, log-sum-exp
parts, counts. Kernels may reduce rows and columns of one score matrix in the same pass; those that are ``tiled`` go through
a block tile by tile and emit one row for each of its rows and columns.
Rows without a vector (null, e.g. a normalised zero vector) take no part. With ``unscored`` such queries leave a task
that holds all candidates as rows of nulls, so that the input is read once; elsewhere operators add them back.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of candidate vectors that are sent to every task.
BROADCAST_BYTES = 16 * 1024 * 1024
#: Bytes of vectors in one block, and the most rows of it.
BLOCK_BYTES, BLOCK_ROWS = 32 * 1024 * 1024, 16_384
#: Score cells computed at once (8 bytes each).
CELLS = 2 * 1024 * 1024
#: Rows and columns of a tile.
TILE = 512
TIE_EPS = 1e-12


@dataclass
class Side:
    """Rows of one side, ids ascending: ids, vectors, and per row a true match (id, vector) if given."""

    ids: np.ndarray
    vecs: np.ndarray
    aux_ids: np.ndarray | None = None
    aux_vecs: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.ids)

    def part(self, at: int, n: int) -> Side:
        cut = slice(at, at + n)
        return Side(self.ids[cut], self.vecs[cut], *(None if x is None else x[cut] for x in (self.aux_ids, self.aux_vecs)))


def _prep(df: DataFrame, id_col: str, vec_col: str, aux_id: str | None, aux_vec: str | None, unscored: bool = False) -> DataFrame:
    cols = [F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")]
    if aux_id:
        cols += [F.col(aux_id).cast("long").alias("aux_id"), F.col(aux_vec).cast("array<double>").alias("aux_vec")]
    out = df.select(*cols)
    if unscored:
        return out
    out = out.filter(F.col("vec").isNotNull())
    return out.filter(F.col("aux_vec").isNotNull()) if aux_id else out


def as_matrix(series) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=np.float64) for v in series])


def _side(pdf: pd.DataFrame, aux: bool) -> Side:
    pdf = pdf.sort_values("id", kind="stable")
    return Side(pdf["id"].to_numpy(np.int64), as_matrix(pdf["vec"].to_numpy()),
                pdf["aux_id"].to_numpy(np.int64) if aux else None, as_matrix(pdf["aux_vec"].to_numpy()) if aux else None)


def _scored(kernel, q: Side, c: Side):
    if getattr(kernel, "tiled", False):
        yield kernel(q, c)
        return
    step = max(1, CELLS // max(1, len(c)))
    for at in range(0, len(q), step):
        yield kernel(q.part(at, step), c)


def block_pairs(queries: DataFrame, cands: DataFrame, kernel, out_schema: str, *,
                q_id: str = "id", q_vec: str = "vec", c_id: str = "id", c_vec: str = "vec",
                q_aux: tuple[str, str] | None = None, c_aux: tuple[str, str] | None = None,
                block_rows: int | None = None, broadcast_bytes: int = BROADCAST_BYTES, unscored: bool = False) -> tuple[DataFrame, bool]:
    """Run ``kernel(q: Side, c: Side) -> pandas`` over all pairs of blocks: (rows of ``out_schema``, whole).

    ``whole``: every query met all candidates in one call, so its row results need no merge.
    ``block_rows`` forces the blocked way with blocks of that size. ``unscored`` (queries without ``q_aux``): when whole,
    a query without a vector gives a row of its ``q_id`` and nulls.
    """
    names = [f.split()[0] for f in out_schema.split(", ")]
    c = _prep(cands, c_id, c_vec, *(c_aux or (None, None)))
    nc, width = c.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    row_bytes = 8 * max(1, width or 1) * (2 if c_aux else 1)
    if block_rows is None and nc * row_bytes <= broadcast_bytes:
        shared = c.sparkSession.sparkContext.broadcast(_side(c.toPandas(), bool(c_aux)))

        def over_queries(it):
            for pdf in it:
                lost = pdf["vec"].isna().to_numpy()
                if lost.any():
                    yield pd.DataFrame({n: pdf["id"][lost] if n == "q_id" else None for n in names})
                    pdf = pdf[~lost]
                if len(pdf) and len(shared.value):
                    yield from _scored(kernel, _side(pdf, bool(q_aux)), shared.value)

        return _prep(queries, q_id, q_vec, *(q_aux or (None, None)), unscored).mapInPandas(over_queries, out_schema), True

    q = _prep(queries, q_id, q_vec, *(q_aux or (None, None)))
    rows = block_rows or max(256, min(BLOCK_ROWS, BLOCK_BYTES // row_bytes))
    nbq, nbc = max(1, math.ceil(q.count() / rows)), max(1, math.ceil(nc / rows))
    aux = bool(q_aux or c_aux)
    none = [F.lit(None).cast("long").alias("aux_id"), F.lit(None).cast("array<double>").alias("aux_vec")]
    extra = lambda has: ["aux_id", "aux_vec"] if has else none if aux else []
    qs = q.select(F.pmod(F.xxhash64("id"), F.lit(nbq)).cast("int").alias("qb"),
                  F.explode(F.sequence(F.lit(0), F.lit(nbc - 1))).alias("cb"), F.lit(0).alias("side"), "id", "vec", *extra(bool(q_aux)))
    cs = c.select(F.explode(F.sequence(F.lit(0), F.lit(nbq - 1))).alias("qb"),
                  F.pmod(F.xxhash64("id"), F.lit(nbc)).cast("int").alias("cb"), F.lit(1).alias("side"), "id", "vec", *extra(bool(c_aux)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [pdf[pdf.side == i] for i in (0, 1)]
        if not all(map(len, sides)):
            return pd.DataFrame({n: [] for n in names})
        return pd.concat(_scored(kernel, _side(sides[0], bool(q_aux)), _side(sides[1], bool(c_aux))), ignore_index=True)

    return qs.unionByName(cs).groupBy("qb", "cb").applyInPandas(run, out_schema), False


# ---- kernels -------------------------------------------------------------

def _best(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` best cells of each row; ties to the smaller column (ids ascend)."""
    k = min(k, s.shape[1])
    if k < s.shape[1]:
        # all cells at least as good as the k-th best, then a stable sort of those alone
        least = -np.partition(-s, k - 1, axis=1)[:, k - 1]
        rows, cols = np.nonzero(s >= least[:, None])
    else:
        rows, cols = (x.ravel() for x in np.indices(s.shape))
    order = np.lexsort((cols, -s[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    starts = np.flatnonzero(np.r_[True, np.diff(rows) != 0])
    rank = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
    return rows[rank < k], cols[rank < k]


def topk_kernel(k: int, scale: float = 1.0):
    """Best ``k`` candidates of each query: rank from 1, score desc, id asc."""
    def kern(q: Side, c: Side) -> pd.DataFrame:
        s = (q.vecs @ c.vecs.T) * scale
        rows, cols = _best(s, k)
        return pd.DataFrame({"q_id": q.ids[rows], "rank": np.arange(len(rows)) % min(k, s.shape[1]) + 1,
                             "c_id": c.ids[cols], "score": s[rows, cols]})
    return kern


TOPK_SCHEMA = "q_id long, rank long, c_id long, score double"


def topk_lse_kernel(k: int, scale: float = 1.0):
    """Top-k of each query with the (max, sum exp) normaliser parts of its row on each of them."""
    def kern(q: Side, c: Side) -> pd.DataFrame:
        s = (q.vecs @ c.vecs.T) * scale
        rows, cols = _best(s, k)
        rank = np.arange(len(rows)) % min(k, s.shape[1]) + 1
        m = s.max(axis=1)
        tot = np.exp(s - m[:, None]).sum(axis=1)
        return pd.DataFrame({"q_id": q.ids[rows], "rank": rank, "c_id": c.ids[cols], "score": s[rows, cols],
                             "m": m[rows], "s": tot[rows]})
    return kern


TOPK_LSE_SCHEMA = "q_id long, rank long, c_id long, score double, m double, s double"


def _tiles(q: Side, c: Side, scale: float):
    """(row, column, scores) of one tile after another."""
    for at in range(0, len(q), TILE):
        for other in range(0, len(c), TILE):
            yield at, other, (q.vecs[at: at + TILE] @ c.vecs[other: other + TILE].T) * scale


class _Summary:
    """Best score, its place among the others, and the sum of exp(score - best) of each row, tile by tile."""

    def __init__(self, n: int):
        self.best, self.m, self.s = np.zeros(n, np.int64), np.full(n, -np.inf), np.zeros(n)

    def add(self, at: int, other: int, s: np.ndarray) -> None:
        cut = slice(at, at + len(s))
        place = np.argmax(s, axis=1)  # first maximum = smallest id among ties
        m = s[np.arange(len(s)), place]
        new = np.maximum(m, self.m[cut])
        self.best[cut] = np.where(m > self.m[cut], other + place, self.best[cut])
        self.s[cut] = self.s[cut] * np.exp(self.m[cut] - new) + np.exp(s - new[:, None]).sum(axis=1)
        self.m[cut] = new

    def rows(self, ids: np.ndarray, others: np.ndarray, side: int) -> pd.DataFrame:
        return pd.DataFrame({"side": side, "q_id": ids, "best_id": others[self.best], "m": self.m, "s": self.s})


def summary_kernel(scale: float = 1.0, both: bool = False):
    """Per query: best candidate (score desc, id asc), max and sum of exp(s - max); ``both``: per candidate as well (side 1)."""
    def kern(q: Side, c: Side) -> pd.DataFrame:
        rows, cols = _Summary(len(q)), _Summary(len(c))
        for at, other, s in _tiles(q, c, scale):
            rows.add(at, other, s)
            if both:
                cols.add(other, at, s.T)
        out = rows.rows(q.ids, c.ids, 0)
        return pd.concat([out, cols.rows(c.ids, q.ids, 1)], ignore_index=True) if both else out

    kern.tiled = True
    return kern


SUMMARY_SCHEMA = "side int, q_id long, best_id long, m double, s double"


class _Better:
    """How many of ``others`` rank above each row's truth: a higher score, or an equal one and a smaller id; tile by tile.

    The truth score and the matrix product sum in different orders, so equal vectors may differ in the last bits: a gap
    below ``TIE_EPS`` ties. Ids ascend, so those before the truth's place count from ``low``, those behind it above ``high``.
    """

    def __init__(self, side: Side, others: np.ndarray, scale: float):
        truth = (side.vecs * side.aux_vecs).sum(axis=1) * scale
        gap = TIE_EPS * np.maximum(1.0, np.abs(truth))
        self.low, self.high = truth - gap, truth + gap
        self.first, self.behind = (np.searchsorted(others, side.aux_ids, x) for x in ("left", "right"))
        self.n = np.zeros(len(side), np.int64)

    def add(self, at: int, other: int, s: np.ndarray) -> None:
        cut, width = slice(at, at + len(s)), s.shape[1]
        low, high = self.low[cut, None], self.high[cut, None]
        first, behind = self.first[cut] - other, self.behind[cut] - other
        if first.min() >= width:
            better = s >= low
        elif behind.max() <= 0:
            better = s > high
        else:
            place = np.arange(width)
            better = np.where(place < first[:, None], s >= low, (s > high) & (place >= behind[:, None]))
        self.n[cut] += np.count_nonzero(better, axis=1)

    def rows(self, ids: np.ndarray, side: int) -> pd.DataFrame:
        return pd.DataFrame({"side": side, "q_id": ids, "n_better": self.n})


def better_count_kernel(scale: float = 1.0, both: bool = False):
    """Per query: candidates ranked above its truth (higher score, or equal score and smaller id); ``both``: per candidate as well."""
    def kern(q: Side, c: Side) -> pd.DataFrame:
        rows, cols = _Better(q, c.ids, scale), _Better(c, q.ids, scale) if both else None
        for at, other, s in _tiles(q, c, scale):
            rows.add(at, other, s)
            if both:
                cols.add(other, at, s.T)
        out = rows.rows(q.ids, 0)
        return pd.concat([out, cols.rows(c.ids, 1)], ignore_index=True) if both else out

    kern.tiled = True
    return kern


BETTER_SCHEMA = "side int, q_id long, n_better long"
