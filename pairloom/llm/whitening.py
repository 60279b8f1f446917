"""Embedding whitening (11) by a covariance that weighs each distinct vector with its multiplicity.

Vectors become whole numbers, identical ones are grouped, and from there on each distinct vector is handled once:
exact sums, a centred and weighted matrix product per task, packed partial matrices summed as a tree, eigenvectors of
the one d x d matrix on the driver, and the projection. The results are joined back to the rows of each group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, stored

SCALE, SHIFT, COMPONENTS = 64.0, 1_000_000, 32
#: Whole numbers beyond this magnitude are not formed: their vectors count as not finite.
LARGEST = float(1 << 62)
#: Partial matrices that one task adds up.
FAN_IN = 16
#: Rows of a matrix product.
BLOCK = 2_048


def whole_numbers(vector: Column, scale: float = SCALE, shift: int = SHIFT) -> Column:
    """``floor(scale * c) + shift`` of every entry as packed little-endian 64-bit integers.

    Null for a null vector and for one with a null entry, a non-finite entry or one beyond 2**62.
    """

    @F.arrow_udf("binary")
    def pack(lists: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        c = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
        with np.errstate(invalid="ignore", over="ignore"):
            x = np.floor(c * scale)
            bad = ~(np.abs(x) < LARGEST)
        x = np.where(bad, 0, x).astype("<i8") + shift
        ends = np.cumsum(sizes)
        wrong = np.r_[0, np.cumsum(bad)]
        usable = (wrong[ends] == wrong[ends - sizes]) & pc.is_valid(lists).to_numpy(zero_copy_only=False)
        raw = x.tobytes()
        return pa.array([raw[8 * (e - n): 8 * e] if ok else None for e, n, ok in zip(ends.tolist(), sizes.tolist(), usable.tolist(), strict=True)], pa.binary())

    return pack(vector.cast("array<double>"))


def _matrix(batch: pa.Array, d: int) -> np.ndarray:
    """Rows of a binary column of packed vectors, as one matrix of 64-bit integers."""
    return np.frombuffer(b"".join(batch.to_pylist()), "<i8").reshape(-1, d)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums`` exactly: 64-bit integers where they suffice, else Python's."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _squares(y: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exactly; None where it is no 64-bit integer."""
    most = int(np.abs(y).max(initial=0))
    total = (y * y if most * most * max(y.shape[1], 1) < 1 << 62 else y.astype(object) ** 2).sum(axis=1).tolist()
    return [t if t < 1 << 63 else None for t in total]


def tree_sum(parts: DataFrame) -> np.ndarray | None:
    """Sum of the packed arrays of ``parts`` (part int, data binary; one row a task), ``FAN_IN`` at a time."""
    parts = stored(parts, "partial-sums")
    left = (parts.agg(F.max("part")).first()[0] or 0) + 1

    def add(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")
        total = sum(np.frombuffer(x, "<f8") for x in rows["data"].to_pylist())
        return pa.table({"part": pa.array([rows["part"][0].as_py() // FAN_IN], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})

    while left > 1:
        parts = parts.groupBy(F.expr(f"part div {FAN_IN}")).applyInArrow(add, "part int, data binary")
        left = math.ceil(left / FAN_IN)
    row = parts.select("data").first()
    return None if row is None else np.frombuffer(row[0], "<f8")


def _products(rows: DataFrame, of) -> DataFrame:
    """(part, data): per task, the sum of ``of(batch)`` over its batches, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                one = of(batch.slice(at, BLOCK))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "data"])

    return rows.mapInArrow(run, "part int, data binary")


def eigen(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as rows.

    Values not above rounding error are left out. A vector's entry of largest magnitude is positive.
    """
    if not len(v):
        return np.zeros(0), np.zeros((0, 0))
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:most], vectors.T[::-1][:most]
    real = values > max(values[0], 0) * len(v) * np.finfo(float).eps * 10
    values, vectors = values[real], vectors[real]
    turn = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)]) if len(vectors) else np.zeros(0)
    return values, vectors * turn[:, None]


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS, weights: str = "count",
           scale: float = SCALE, shift: int = SHIFT) -> DataFrame:
    """Add the struct ``whitening`` to every row with a usable vector; the other rows go.

    A vector is usable if it is not null, has no null or non-finite entry (nor one beyond 2**62 / ``scale``) and as
    many entries as most usable vectors have (ties: the larger number). ``weights``: "count" fits on all rows, "one" on
    each distinct vector once. Fields: n (size of the fit list), deviation (sum over dimensions of (n * x - sums)**2,
    null beyond 64 bits), values (one for each component, at most ``components``; fewer where the vectors
    span fewer dimensions, none where all are equal), explained (share of the trace for each component),
    identity_error. An empty table gives an empty table, repeated rows get equal results, other
    columns pass through (one named ``whitening`` is replaced).
    """
    if weights not in ("count", "one"):
        raise ValueError(f"unknown weights {weights!r}")
    kind = "n long, deviation long, values array<double>, explained array<double>, identity_error double"
    rows = rows.drop("whitening").withColumn("_llm_x", whole_numbers(F.col(vector), scale, shift)).where(F.col("_llm_x").isNotNull())
    groups = stored(rows.groupBy(F.col("_llm_x").alias("x")).agg(F.count(F.lit(1)).alias("rows")), "distinct-vectors")
    sizes = groups.groupBy(F.octet_length("x").alias("size")).agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("groups"))
    most = sizes.orderBy(F.desc("rows"), F.desc("size")).first()
    if most is None:
        return rows.drop("_llm_x").withColumn("whitening", F.lit(None).cast(f"struct<{kind.replace(' ', ':').replace(',:', ',')}>"))
    d, total = most["size"] // 8, most["rows"]
    n = total if weights == "count" else most["groups"]
    groups = groups.where(F.octet_length("x") == most["size"]).withColumn("weight", F.col("rows") if weights == "count" else F.lit(1).cast("long"))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for batch in batches:
            x, w = _matrix(batch.column("x"), d), batch.column("weight").to_numpy()
            small = int(np.abs(x).max(initial=0)) * int(w.sum()) < 1 << 62
            part = (x * w[:, None]).sum(axis=0) if small else (x.astype(object) * w[:, None]).sum(axis=0)
            total = [a + b for a, b in zip(total, part.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(map(Decimal, total), pa.decimal128(38, 0))], names=["dim", "s"])

    by_dim = groups.select("x", "weight").mapInArrow(add_up, "dim int, s decimal(38,0)").groupBy("dim").agg(F.sum("s").cast("decimal(38,0)").alias("s"))
    sums = [int(r.s) for r in by_dim.orderBy("dim").collect()]  # d numbers

    def covariance(batch: pa.RecordBatch) -> np.ndarray:
        y = _centred(_matrix(batch.column("x"), d), n, sums).astype(float) / n
        return ((y * batch.column("weight").to_numpy()[:, None]).T @ y).ravel()

    v = tree_sum(_products(groups.select("x", "weight"), covariance)).reshape(d, d) / n
    values, axes = eigen((v + v.T) / 2, components)
    project = axes.T / np.sqrt(values)
    k = len(values)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                y = _centred(_matrix(batch.column("x"), d), n, sums)
                z = (y.astype(float) / n) @ project if k else np.zeros((len(y), 0))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * k, pa.int32()), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("rows"), batch.column("weight"), pa.array(_squares(y), pa.int64()), lists],
                                                 names=["x", "rows", "weight", "deviation", "values"])

    white = stored(groups.mapInArrow(apply, "x binary, rows long, weight long, deviation long, values array<double>"), "whitened")

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        z, w = batch.column("values").flatten().to_numpy().reshape(-1, k), batch.column("weight").to_numpy()[:, None]
        return np.r_[(z * w).sum(axis=0), ((z * w).T @ z).ravel()]

    error = 0.0
    if k:
        m = tree_sum(_products(white.select("values", "weight"), moments)) / n
        error = float(np.abs(m[k:].reshape(k, k) - np.outer(m[:k], m[:k]) - np.eye(k)).max())
    shares = F.array(*[F.lit(float(e)) for e in values / np.trace(v)]) if k else F.array().cast("array<double>")
    keys = white.select(F.sha2("x", 256).alias("_llm_key"), "rows", F.struct(
        F.lit(n).cast("long").alias("n"), "deviation", "values", shares.alias("explained"), F.lit(error).alias("identity_error")).alias("whitening"))
    keyed = rows.where(F.octet_length("_llm_x") == most["size"]).withColumn("_llm_key", F.sha2("_llm_x", 256)).drop("_llm_x")
    spread = F.monotonically_increasing_id()  # any place of a hot vector gives the same result
    return join_counted(keyed, keys, ["_llm_key"], "rows", total, spread).drop("_llm_key")
