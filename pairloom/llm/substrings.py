"""Substring dedup (12): passages that stand in an earlier document too, found by level-wise doubling.

Windows of words grow from a short length to the judged one, each length at most twice the one before (13, 25, 50).
Of the shortest windows only anchors count: the window of lowest hash among all that lie in a judged window, so that
equal judged windows have equal anchors. A level counts the windows of its length that stand around the surviving
anchors; where a window stands in one document alone, the judged windows around it are no candidates any more. Only
candidates that survive all levels are compared as a whole, by 128-bit hashes. Texts that equal an earlier
text whole take no part: all their windows stand there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, hash64, join_counted, mix64, slices, stored

WINDOW = 50
#: The shortest windows have this many words or a few more.
SHORTEST = 12
#: Texts handled at once, and words whose windows are compared at once (places take 20 bits).
ROWS, BLOCK = 64, 1 << 19
#: Bytes of copies' keys, and of runs of starts, that every worker may hold; more are joined.
BROADCAST_BYTES = 32 << 20
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def levels(window: int, shortest: int = SHORTEST) -> list[int]:
    """Window lengths, each at most twice the one before."""
    if not 1 <= window <= BLOCK:
        raise ValueError(f"a window has 1 to {BLOCK} words")
    out = [window]
    while out[0] >= 2 * shortest:
        out.insert(0, (out[0] + 1) // 2)
    return out


class Windows:
    """Word hashes of some texts in one flat array, and sums that give the hash of any window of words."""

    def __init__(self, texts: list[str | None], memo: Memo):
        words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.ends = np.cumsum(self.sizes)
        self.words = np.fromiter(map(memo.__getitem__, chain.from_iterable(words)), np.uint64, int(self.sizes.sum()))
        self.sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def hashes(self, starts: np.ndarray, length: int, way: int = 0) -> np.ndarray:
        """Hash of the window at each start: a polynomial of the words' hashes, mod 2**64."""
        if way not in self.sums:
            n = len(self.words)
            with np.errstate(over="ignore"):
                power = np.cumprod(np.full(n + 1, _ODD[way]))  # power[i]: odd ** (i + 1)
                back = np.cumprod(np.full(n + 1, np.uint64(pow(int(_ODD[way]), -1, 1 << 64))))
                words = self.words if way == 0 else mix64(self.words ^ _ODD[way])
                self.sums[way] = np.r_[np.uint64(0), np.cumsum(words * power[:n])], back
        sums, back = self.sums[way]
        return mix64((sums[starts + length] - sums[starts]) * back[starts] + np.uint64(length))

    def starts(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, start) of every window of ``length`` words that lies in one text."""
        each = np.maximum(self.sizes - length + 1, 0)
        row = np.repeat(np.arange(len(each)), each)
        first = (self.ends - self.sizes)[row]
        return row, first + np.arange(len(row)) - (np.cumsum(each) - each)[row]


def anchors(w: Windows, window: int, short: int) -> tuple[np.ndarray, ...]:
    """(row, place of the anchor, first and last start of the judged windows it stands for), positions in the flat array."""
    row, start = w.starts(window)
    if not len(start):
        return row, start, start, start
    places, at, span = [], 0, window - short + 1
    while at < len(start):
        stop = int(np.searchsorted(start, start[at] + BLOCK))
        places.append(_lowest(w, start[at:stop], short, span))
        at = stop
    place = np.concatenate(places)
    new = np.flatnonzero(np.r_[True, (np.diff(place) != 0) | (np.diff(row) != 0)])
    last = np.r_[new[1:], len(place)] - 1
    return row[new], place[new], start[new], start[last]


def _lowest(w: Windows, start: np.ndarray, short: int, span: int) -> np.ndarray:
    """For each start, the place of the lowest hash (its upper 44 bits, then the leftmost) among ``span`` short windows."""
    base = int(start[0])
    n = int(start[-1] - base) + span
    key = (mix64(w.hashes(np.arange(base, base + n), short)) >> np.uint64(20) << np.uint64(20)) | np.arange(n, dtype=np.uint64)
    width = 1
    while 2 * width <= span:  # key[i]: lowest of `width` windows from i
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    at = start - base
    low = np.minimum(key[at], key[at + span - width])
    return base + (low & np.uint64((1 << 20) - 1)).astype(np.int64)


def text_keys(text: Column) -> list[Column]:
    """Two 64-bit hashes that tell texts apart; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("_llm_t1"), F.xxhash64(F.lit(1), text).alias("_llm_t2")]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _find_anchors(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """Anchors of the rows (_llm_id, _llm_r, _llm_text), with the hashes of the windows around them at each level.

    ``right<i>`` and ``left<i>`` belong to the window of level i that starts and the one that ends with the
    anchor (0 where it leaves the text); ``a`` and ``b`` are the first and last start of the judged windows.
    """
    window, short, between = lengths[-1], lengths[0], list(enumerate(lengths[1:-1], 1))
    id_type = rows.schema["_llm_id"].dataType.simpleString()
    around = [f"{side}{i}" for i, _ in between for side in ("right", "left")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(hash64)
        for batch in batches:
            for part in slices(batch, ROWS):
                w = Windows(part.column("_llm_text").to_pylist(), memo)
                row, place, first, last = anchors(w, window, short)
                if not len(row):
                    continue
                begin, end = (w.ends - w.sizes)[row], w.ends[row]
                hashes = []
                for _, length in between:
                    for start in (place, place + short - length):
                        inside = np.flatnonzero((start >= begin) & (start + length <= end))
                        one = np.zeros(len(row), np.uint64)
                        one[inside] = w.hashes(start[inside], length)
                        hashes.append(_signed(one))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c).take(take) for c in ("_llm_id", "_llm_r")] + [_signed(w.hashes(place, short)), *hashes]
                    + [pa.array((x - begin).astype(np.int32)) for x in (place, first, last)], names=["id", "r", "h", *around, "place", "a", "b"])

    kinds = "".join(f"{x} long, " for x in around)
    return rows.select("_llm_id", "_llm_r", "_llm_text").mapInArrow(run, f"id {id_type}, r long, h long, {kinds}place int, a int, b int")


def _shared(rows: DataFrame, on: list[str]) -> DataFrame:
    """The keys ``on`` that rows of several ids have: their smallest id ``least`` and number of rows ``n_rows``.

    A null id counts as the largest.
    """
    counts = rows.groupBy(*on).agg(F.min("id").alias("least"), F.max("id").alias("most"), F.max(F.col("id").isNull()).alias("odd"), F.count(F.lit(1)).alias("n_rows"))
    return counts.where((F.col("least") != F.col("most")) | (F.col("odd") & F.col("least").isNotNull())).drop("most", "odd")


def _spread() -> Column:
    return F.xxhash64("r", "a")


def _survivors(found: DataFrame, lengths: list[int]) -> DataFrame:
    """Anchors with the judged windows that are left after each level."""
    window, short = lengths[-1], lengths[0]
    total = found.count()
    left = stored(join_counted(found, _shared(found, ["h"]).drop("least"), ["h"], "n_rows", total, _spread()).drop("h"), "anchors")
    for i, length in enumerate(lengths[1:-1], 1):
        total = left.count()
        if total == 0:
            break
        for side in ("right", "left"):
            of = left.withColumnRenamed(f"{side}{i}", "h")
            keys = _shared(of, ["h"]).withColumn("met", F.lit(True)).drop("least")
            left = join_counted(of, keys, ["h"], "n_rows", total, _spread(), "left").drop("h")
            # A window of one document alone: the judged windows that hold it go.
            if side == "right":
                left = left.withColumn("b", F.when(F.col("met"), F.col("b")).otherwise(F.least("b", F.col("place") + (length - window - 1))))
            else:
                left = left.withColumn("a", F.when(F.col("met"), F.col("a")).otherwise(F.greatest("a", F.col("place") + (short - length + 1))))
            left = left.where(F.col("a") <= F.col("b")).drop("met")
        left = stored(left, "anchors")
    return left


def _judged_windows(rows: DataFrame, window: int) -> DataFrame:
    """(id, r, a, h1, h2) of every candidate start ``a`` in the column ``_llm_runs`` of the rows."""
    id_type = rows.schema["_llm_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(hash64)
        for batch in batches:
            for part in slices(batch, ROWS):
                w = Windows(part.column("_llm_text").to_pylist(), memo)
                begin = w.ends - w.sizes
                runs = [(i, x["a"], x["b"]) for i, xs in enumerate(part.column("_llm_runs").to_pylist()) for x in xs]
                row = np.repeat([i for i, _, _ in runs], [b - a + 1 for _, a, b in runs]).astype(np.int64)
                start = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, b + 1) + begin[i] for i, a, b in runs)])
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c).take(take) for c in ("_llm_id", "_llm_r")] + [pa.array((start - begin[row]).astype(np.int32))]
                    + [_signed(w.hashes(start, window, way)) for way in (0, 1)], names=["id", "r", "a", "h1", "h2"])

    return rows.select("_llm_id", "_llm_r", "_llm_text", "_llm_runs").mapInArrow(run, f"id {id_type}, r long, a int, h1 long, h2 long")


def _merged(lists: pa.Array) -> pa.Array:
    """Runs of starts (a to b) that overlap or touch become one, in order."""
    offsets, flat = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
    row = np.repeat(np.arange(len(lists)), np.diff(offsets))
    a, b = (flat.field(k).to_numpy().astype(np.int64) for k in ("a", "b"))
    order = np.lexsort((a, row))
    row, a, b = row[order], a[order], b[order]
    high = np.maximum.accumulate(b + (row << 32)) - (row << 32) if len(b) else b  # furthest end so far in the row
    new = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (a[1:] > high[:-1] + 1)]) if len(b) else np.zeros(0, np.int64)
    last = np.r_[new[1:], len(b)][: len(new)] - 1
    runs = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (a[new], high[last])], names=["a", "b"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[new], np.arange(len(lists) + 1)), pa.int32()), runs)


def _runs(rows: DataFrame) -> DataFrame:
    """The runs of starts ``_llm_runs`` of each text, from single ones; a list is at most as long as the text."""
    lists = rows.groupBy(F.col("id").alias("_llm_i"), F.col("r").alias("_llm_o")).agg(F.collect_list(F.struct("a", "b")).alias("l"))
    return stored(lists.select("_llm_i", "_llm_o", F.arrow_udf(_merged, "array<struct<a:int,b:int>>")("l").alias("_llm_runs")), "runs")


def _with_runs(rows: DataFrame, runs: DataFrame, how: str) -> DataFrame:
    """Join by text, moving no text where the runs are few."""
    n, items = runs.agg(F.count(F.lit(1)), F.sum(F.size("_llm_runs"))).first()
    small = F.broadcast(runs) if n * 64 + (items or 0) * 16 <= BROADCAST_BYTES else runs
    same = F.col("_llm_id").eqNullSafe(F.col("_llm_i")) & (F.col("_llm_r") == F.col("_llm_o"))
    return rows.join(small, same, how).drop("_llm_i", "_llm_o")


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, shortest: int = SHORTEST) -> DataFrame:
    """Add the struct ``repeats``: n_words, n_removed, kept_text.

    A word goes if it lies in a window of ``window`` words whose sequence also starts in a document with a smaller id
    (any type that sorts; a null id counts as the largest). Windows are judged on the texts given, not on what is
    left. Kept words are joined by one space. Null, empty and blank texts have no words; texts shorter than the
    window lose none. Rows with one id judge nothing by each other, repeated rows get equal results, an empty table
    gives an empty table, other columns pass through (one named ``repeats`` is replaced).
    """
    lengths = levels(window, shortest)
    docs = docs.drop("repeats")
    keyed = docs.select("*", F.col(doc_id).alias("_llm_id"), F.col(text).alias("_llm_text"), *text_keys(F.col(text)))
    copies = _shared(keyed.select(F.col("_llm_id").alias("id"), "_llm_t1", "_llm_t2"), ["_llm_t1", "_llm_t2"])
    copies = stored(copies.select("_llm_t1", "_llm_t2", F.col("least").alias("_llm_least"), F.col("n_rows").alias("_llm_n")), "copies")
    if copies.count() * 48 <= BROADCAST_BYTES:
        keyed = keyed.join(F.broadcast(copies.drop("_llm_n")), ["_llm_t1", "_llm_t2"], "left")
    else:
        keyed = join_counted(keyed, copies, ["_llm_t1", "_llm_t2"], "_llm_n", docs.count(), F.xxhash64("_llm_id"), "left")
    copy = F.col("_llm_least").isNotNull() & (F.col("_llm_id").isNull() | (F.col("_llm_id") > F.col("_llm_least")))
    keyed = keyed.withColumn("_llm_copy", copy).withColumn("_llm_r", F.xxhash64("_llm_t1", "_llm_t2"))  # tells texts of one id apart
    first = keyed.where(~F.col("_llm_copy"))
    left = _survivors(stored(_find_anchors(first, lengths), "anchors"), lengths)
    windows = stored(_judged_windows(_with_runs(first, _runs(left), "inner"), window), "windows")
    least = windows.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n_rows"))
    met = join_counted(windows, least.where((F.col("n_rows") > 1) & F.col("least").isNotNull()), ["h1", "h2"], "n_rows", windows.count(), _spread())
    gone = met.where(F.col("id").isNull() | (F.col("id") > F.col("least"))).select("id", "r", "a", F.col("a").alias("b"))
    judged = _with_runs(keyed, _runs(gone), "left")

    @F.arrow_udf("n_words long, n_removed long, kept_text string")
    def cut(texts: pa.Array, copied: pa.Array, runs: pa.Array) -> pa.Array:
        out = [_cut([], [], [], window)]
        for at in range(0, len(texts), ROWS):
            out.append(_cut(*(x.slice(at, ROWS).to_pylist() for x in (texts, copied, runs)), window))
        return pa.concat_arrays(out)

    return judged.withColumn("repeats", cut("_llm_text", "_llm_copy", "_llm_runs")).drop(
        "_llm_id", "_llm_text", "_llm_t1", "_llm_t2", "_llm_least", "_llm_copy", "_llm_r", "_llm_runs")


def _cut(texts: list, copied: list, runs: list, window: int) -> pa.Array:
    sizes, removed, kept = [], [], []
    for t, copy, at in zip(texts, copied, runs, strict=True):
        words = (t or "").encode("utf-8", "surrogatepass").split()
        n = len(words)
        if copy and n >= window:
            words = []
        else:
            until = n
            for x in reversed(at or []):
                words[x["a"]: min(x["b"] + window, until)] = []
                until = x["a"]
        sizes.append(n)
        removed.append(n - len(words))
        kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
    return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["n_words", "n_removed", "kept_text"])
