"""Document fingerprints (7): context-triggered piecewise hashing.

A rolling hash over 7 bytes cuts a text wherever it hits a value modulo the block size; each chunk gives one character of
the signature. An edit changes the chunks it touches and no others. A fingerprint is ``block:signature:signature at twice the
block``; two fingerprints are compared by edit distance where their block sizes agree, or are one doubling apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegralType, NumericType

from ..plans.indexing import assign_buckets
from .common import mix64

WINDOW = 7
LENGTH = 64
MIN_BLOCK = 2
#: Signatures without a common run of so many characters are taken as unrelated.
COMMON_RUN = 4
#: Bytes of text whose arrays (some 50 bytes each) are held at once.
AT_ONCE = 4 * 1024 * 1024
#: Most ranges of ids; the driver sees 64 sample ids of each.
MAX_RANGES = 16_384
_CHARS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_MULTIPLIER = np.uint64(0x100000001B3)


def _rolling(flat: np.ndarray) -> np.ndarray:
    """Hash of the 7 bytes that end at each place: sum, weighted sum, and shifted exclusive or."""
    c = np.r_[np.zeros(WINDOW - 1, np.uint32), flat.astype(np.uint32)]
    n = len(flat)
    out, shifted = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for j in range(WINDOW):
        back = c[WINDOW - 1 - j: WINDOW - 1 - j + n]
        out += back * np.uint32(WINDOW - j + 1)
        shifted ^= back << np.uint32(5 * j)
    return out + shifted


def _signatures(flat: np.ndarray, roll: np.ndarray, starts: np.ndarray, sizes: np.ndarray, block: np.ndarray) -> list[str]:
    """One signature per text of the flat array (texts lie apart by window padding; ``starts`` skips it)."""
    doc = np.repeat(np.arange(len(starts)), sizes)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
    data, block = flat[place], np.repeat(block, sizes).astype(np.uint32)
    cut = np.flatnonzero(roll[place] % block == block - np.uint32(1))
    per_doc = np.bincount(doc[cut], minlength=len(starts))
    order = np.arange(len(cut)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    cut = cut[order < LENGTH - 1]
    head = np.cumsum(sizes) - sizes
    begin = np.unique(np.r_[head[sizes > 0], cut + 1])
    begin = begin[begin < len(doc)]
    if not len(begin):
        return [""] * len(starts)
    length = np.diff(np.r_[begin, len(doc)])
    within = np.arange(len(doc)) - np.repeat(begin, length)
    power = np.multiply.accumulate(np.full(int(length.max()), _MULTIPLIER, np.uint64))
    sums = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * power[within], begin)
    chars = _CHARS[(mix64(sums) & np.uint64(63)).astype(np.int64)].tobytes().decode()
    count = np.cumsum(np.r_[0, np.bincount(doc[begin], minlength=len(starts))])
    return [chars[a:b] for a, b in zip(count[:-1].tolist(), count[1:].tolist(), strict=True)]


def fingerprints(texts: list[bytes]) -> list[str]:
    """The fingerprint of each text; equal texts have equal ones, the empty text has ``2::``. ``AT_ONCE`` bytes (or one longer text) at a time."""
    out: list[str] = []
    begin = size = 0
    for i, t in enumerate(texts):
        if size + len(t) > AT_ONCE and i > begin:
            out += _fingerprints(texts[begin:i])
            begin, size = i, 0
        size += len(t)
    return out + _fingerprints(texts[begin:]) if begin < len(texts) else out


def _fingerprints(texts: list[bytes]) -> list[str]:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    pad = b"\0" * (WINDOW - 1)
    flat = np.frombuffer(b"".join(pad + t for t in texts), np.uint8)
    starts = np.cumsum(sizes + len(pad)) - sizes
    roll = _rolling(flat)
    block = MIN_BLOCK << np.maximum(0, np.ceil(np.log2(np.maximum(sizes, 1) / (LENGTH * MIN_BLOCK)))).astype(np.int64)
    first = np.array([""] * len(texts), object)
    todo = np.arange(len(texts))
    while len(todo):
        first[todo] = _signatures(flat, roll, starts[todo], sizes[todo], block[todo])
        # Too few chunks: halve the block size and try again.
        todo = todo[[len(first[i]) < LENGTH // 2 and block[i] > MIN_BLOCK for i in todo]]
        block[todo] //= 2
    second = _signatures(flat, roll, starts, sizes, block * 2)
    return [f"{b}:{x}:{y}" for b, x, y in zip(block.tolist(), first, second, strict=True)]


def _lcs(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of longest common subsequences, 64 places in one machine word for many pairs at once."""
    x, y = (np.array([s.encode().ljust(LENGTH, pad) for s in t], f"S{LENGTH}").view(np.uint8).reshape(-1, LENGTH) for t, pad in ((a, b"\1"), (b, b"\2")))
    bits = np.uint64(1) << np.arange(LENGTH, dtype=np.uint64)
    state = np.full(len(a), ~np.uint64(0))
    for j in range(max(map(len, b), default=0)):
        match = ((x == y[:, j, None]) * bits).sum(axis=1, dtype=np.uint64)
        both = state & match
        state = (state + both) | (state - both)
    return LENGTH - np.bitwise_count(state).astype(np.int64)


def _common_run(a: str, b: str) -> bool:
    n = min(COMMON_RUN, len(a), len(b))
    return n > 0 and not {a[i:i + n] for i in range(len(a) - n + 1)}.isdisjoint(b[i:i + n] for i in range(len(b) - n + 1))


def likeness(left: list[str], right: list[str]) -> list[float]:
    """1 - (insertions and deletions) / (both lengths) of compatible signatures: 1 for equal fingerprints, 0 for unrelated ones."""
    out = [0.0] * len(left)
    todo: list[tuple[int, str, str]] = []
    for i, (p, q) in enumerate(zip(left, right, strict=True)):
        if p == q:
            out[i] = 1.0
            continue
        (b, p1, p2), (c, q1, q2) = ((int(s[0]), s[1], s[2]) for s in (p.split(":"), q.split(":")))
        pairs = [(p1, q1), (p2, q2)] if b == c else [(p2, q1)] if 2 * b == c else [(p1, q2)] if b == 2 * c else []
        todo += [(i, x, y) for x, y in pairs if _common_run(x, y)]
    if todo:
        at, x, y = map(list, zip(*todo, strict=True))
        for i, s, t, common in zip(at, x, y, _lcs(x, y).tolist(), strict=True):
            out[i] = max(out[i], 2 * common / (len(s) + len(t)))
    return out


def add_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add ``out``; null texts have that of the empty text. Other columns pass through."""

    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found: list[str] = []
            for at in range(0, len(texts), 64):
                found += fingerprints([(t or "").encode("utf-8", "surrogatepass") for t in texts.slice(at, 64).to_pylist()])
            yield pa.array(found, pa.string())

    return docs.withColumn(out, F.arrow_udf(made, "string")(F.col(text)))


def add_likeness(rows: DataFrame, a: str, b: str, out: str = "likeness") -> DataFrame:
    """Add ``out``: the likeness of two fingerprint columns; null where one is null."""

    def made(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in batches:
            x, y = x.to_pylist(), y.to_pylist()
            some = [i for i in range(len(x)) if x[i] is not None and y[i] is not None]
            got = dict(zip(some, likeness([x[i] for i in some], [y[i] for i in some]), strict=True))
            yield pa.array([got.get(i) for i in range(len(x))], pa.float64())

    return rows.withColumn(out, F.arrow_udf(made, "double")(F.col(a), F.col(b)))


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit: the last third gives way to the start of the next document.

    Returns ``id_col``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited. The next document is
    the one before in id order (after the last: the first); rows that repeat an id follow each other by a hash of
    their text; a null id counts as the smallest. Numbers are in the order of their values, ids of other types in that of their
    strings. Null texts are empty. A single row follows itself, an empty table gives an empty table, other columns are left out.

    Texts move once, into ranges of ids; a range begins with a copy of the last row of the range below.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = docs.schema[id_col].dataType
    key = F.col("id").cast("long" if isinstance(kind, IntegralType) else "double" if isinstance(kind, NumericType) else "string")
    order = [F.col("id").isNotNull(), F.coalesce(key, F.lit(0) if isinstance(kind, NumericType) else F.lit("")), F.bitwise_not(F.xxhash64("text"))]
    rows = rows.withColumns({f"k{i}": o for i, o in enumerate(order)})
    n_ranges = max(2, min(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), MAX_RANGES))
    placed = assign_buckets(rows, ["k0", "k1", "k2"], [], n_ranges, name="range").withColumn("key", F.struct("k0", "k1", "k2"))
    tails = placed.groupBy("range").agg(F.max("key").alias("tail"))
    # One row a range: a window over them all is bounded by the number of ranges.
    whole = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tails = tails.withColumn("to", F.coalesce(F.lead("range").over(Window.orderBy("range")), F.min("range").over(whole)))
    ends = (placed.join(F.broadcast(tails.withColumnRenamed("range", "of")), (F.col("range") == F.col("of")) & (F.col("key") == F.col("tail")))
            .select("id", "text", "key", F.col("to").alias("range"), F.lit(0).alias("own")))
    ranged = placed.select("id", "text", "key", "range", F.lit(1).alias("own")).unionByName(ends)
    ranged = ranged.repartition(n_ranges, "range").sortWithinPartitions("range", "own", "key").select("id", "text", "range", "own")

    def pairs(batches):
        """(row, next text): a row's next stands before it in the same range."""
        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64).to_pylist()
                out = []
                for r in part:
                    if r["own"] and held is not None and held["range"] == r["range"]:
                        out.append((r, held["text"]))
                    held = r
                if out:
                    yield _judged(out, id_col, to_arrow_type(kind))

    return ranged.mapInArrow(pairs, f"{id_col} {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, "
                             "edited_fingerprint string, near_edited double, near_next double, edited string")


def _judged(out: list, name: str, kind: pa.DataType) -> pa.RecordBatch:
    ids, texts, nexts = [r["id"] for r, _ in out], [r["text"] for r, _ in out], [t for _, t in out]
    third = [len(t) // 3 for t in texts]
    edited = [t[: len(t) - k] + x[:k] for t, x, k in zip(texts, nexts, third, strict=True)]
    raw = [t.encode("utf-8", "surrogatepass") for t in edited]
    own = fingerprints([t.encode("utf-8", "surrogatepass") for t in texts])
    changed = fingerprints(raw)
    following = fingerprints([t.encode("utf-8", "surrogatepass") for t in nexts])
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, kind), pa.array(list(map(len, texts)), pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raw]),
         pa.array(own, pa.string()), pa.array(changed, pa.string()), pa.array(likeness(own, changed), pa.float64()),
         pa.array(likeness(own, following), pa.float64()), pa.array(edited, pa.string())],
        names=[name, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited"])
