"""Language identification (8) by error-correcting output codes.

Every language gets a codeword of bits; for each bit a binary classifier over n-grams of the text's letters tells the languages with 1 from
those with 0. A text's bits are compared with all codewords, each bit weighted by how sure and how good its classifier is;
the codeword with the least loss wins, and a close second flags the text as ambiguous.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fit_sample, hash64, one_text_each

FEATURES = 1 << 16  # grams() keeps 16 bits
#: Bound of the training sample: so many documents of each language, the smallest by hash of their id.
PER_LANGUAGE = 300
EPOCHS = 30
AMBIGUOUS = 0.2
UNKNOWN = "und"
_SIZES = (1, 2, 3, 4, 5)
#: Bytes whose n-grams are held at once; longer texts are taken in overlapping pieces.
PIECE = 1 << 18
#: ASCII characters other than letters become spaces; bytes of other characters stay.
_LETTERS_ONLY = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def grams(text: str) -> Iterator[np.ndarray]:
    """Hashed 1- to 5-grams of the text's lower-case letters (UTF-8 bytes, words apart by one space), piece by piece."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS_ONLY).split()) + b" "
    for at in range(0, len(raw), PIECE):
        flat = np.frombuffer(raw[at: at + PIECE + _SIZES[-1] - 1], np.uint8).astype(np.uint32)
        own = min(PIECE, len(raw) - at)
        h, out = np.zeros(len(flat), np.uint32), []
        for n in _SIZES:
            # h[i]: the n bytes from i on
            h = h[: len(flat) - n + 1] * np.uint32(0x01000193) + flat[n - 1:] + np.uint32(n)
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            out.append((mixed[:own] >> np.uint32(16)).astype(np.int32))
        yield np.concatenate(out)


def codewords(n: int) -> np.ndarray:
    """(n, bits) of -1 and 1. Up to 7 languages every split in two parts is a bit; beyond, hashed bits, 15 for each doubling."""
    if n <= 1:
        return np.ones((n, 1), np.int64)
    if n <= 7:
        splits = [s for s in itertools.product((-1, 1), repeat=n) if s[0] == 1 and -1 in s]
        return np.array(splits, np.int64).T
    bits = 15 * int(np.ceil(np.log2(n)))
    best, distance = None, -1
    for salt in range(20):
        code = np.array([[1 if hash64(b"%d:%d:%d" % (salt, i, j)) & 1 else -1 for j in range(bits)] for i in range(n)], np.int64)
        apart = ((bits - code @ code.T) // 2 + bits * np.eye(n, dtype=np.int64)).min()
        if apart > distance:
            best, distance = code, apart
    return best


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.languages, self.weights, self.bias, self.trust = languages, weights, bias, trust
        self.code = codewords(len(languages))

    def judge(self, z: np.ndarray) -> tuple[str, float, bool]:
        """Language, score and ambiguity of the bits' margins."""
        loss = (np.logaddexp(0.0, -self.code * z) * self.trust).sum(axis=1)
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        order = np.argsort(-p, kind="stable")
        close = len(order) > 1 and p[order[0]] - p[order[1]] < AMBIGUOUS
        return self.languages[order[0]], float(p[order[0]]), bool(close)


def fit(texts: list[str], langs: list[str], epochs: int = EPOCHS, rate: float = 0.5) -> Model | None:
    """Adagrad on each bit over the mean n-gram weights; None without a usable text."""
    pairs = [(t, y) for t, y in zip(texts, langs, strict=True) if has_letter(t)]
    if not pairs:
        return None
    names = sorted({y for _, y in pairs})
    code = codewords(len(names))
    rows, cols, values = [], [], []
    for i, (t, _) in enumerate(pairs):
        counts = sum(np.bincount(g, minlength=FEATURES) for g in grams(t))
        found = np.flatnonzero(counts)
        counts = counts[found]
        rows.append(np.full(len(found), i, np.int32))
        cols.append(found.astype(np.int32))
        values.append((counts / counts.sum()).astype(np.float32))
    rows, cols, values = np.concatenate(rows), np.concatenate(cols), np.concatenate(values)
    starts = np.searchsorted(rows, np.arange(len(pairs)))
    target = code[[names.index(y) for _, y in pairs]]
    # Rare languages count as much as frequent ones.
    share = np.array([1.0 / sum(y == n for _, y in pairs) for n in names])[[names.index(y) for _, y in pairs]]
    w, b, trust = np.zeros((FEATURES, code.shape[1]), np.float32), np.zeros(code.shape[1]), np.ones(code.shape[1])
    by_col = np.argsort(cols, kind="stable")
    heads = np.flatnonzero(np.r_[True, np.diff(cols[by_col]) != 0])
    used = cols[by_col][heads]
    for j in range(code.shape[1]):
        weight, bias, seen, seen_b = np.zeros(FEATURES), 0.0, np.full(len(used), 1e-8), 1e-8
        for _ in range(epochs):
            z = bias + np.add.reduceat(values * weight[cols], starts)
            g = -target[:, j] * share / (1 + np.exp(np.clip(target[:, j] * z, -50, 50)))
            grad = np.add.reduceat((values * g[rows])[by_col], heads) + 1e-7 * weight[used]
            seen += grad * grad
            seen_b += g.sum() ** 2
            weight[used] -= rate * grad / np.sqrt(seen)
            bias -= rate * g.sum() / np.sqrt(seen_b)
        z = bias + np.add.reduceat(values * weight[cols], starts)
        w[:, j], b[j] = weight, bias
        right = float((share * (z * target[:, j] > 0)).sum() / share.sum())
        trust[j] = max(2 * right - 1, 1e-3)
    return Model(names, w, b, trust)


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """Fit on the bounded sample; rows with null language or text do not count.

    Of several rows of one id and language the text of lowest hash counts. A language gives ``per_language`` documents, in the order
    of a hash of id and text, and all together not more than ``SAMPLE_BYTES`` of text. None without any.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).alias("doc"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    keys = rows.select("doc", "lang", F.xxhash64("text").alias("th"))
    ids = keys.groupBy("doc", "lang").agg(F.min("th").alias("th")).withColumn("_llm_h", F.xxhash64(F.lit(8), "doc", "th"))
    # Within salts first, then over at most salts * per_language rows: a hot language meets no single task.
    for part in (["lang", F.pmod("_llm_h", F.lit(64))], ["lang"]):
        ids = ids.withColumn("r", F.row_number().over(Window.partitionBy(*part).orderBy("_llm_h", "doc"))).where(F.col("r") <= per_language)
    pick = F.broadcast(ids.select(F.col("doc").alias("_llm_d"), F.col("lang").alias("_llm_l"), "th", "_llm_h"))
    same = F.col("doc").eqNullSafe(F.col("_llm_d")) & (F.col("lang") == F.col("_llm_l")) & (F.xxhash64("text") == F.col("th"))
    return fit_sample(one_text_each(rows.join(pick, same), ["doc", "lang"], ["_llm_h"]), "lang", fit)


def detect(docs: DataFrame, model: Model | None, text: str = "text", out: str = "language") -> DataFrame:
    """Add the struct ``out`` (lang, score, ambiguous) to every row; ``und`` with score 0 for null and texts without a letter, or without a model.

    Repeated rows get equal results, an empty table gives an empty table, other columns pass through (one named ``out`` is replaced).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model and (model.languages, model.weights, model.bias, model.trust))

    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value and Model(*shared.value)

        def one(t: str | None) -> tuple[str, float, bool]:
            if m is None or not has_letter(t):
                return UNKNOWN, 0.0, False
            total, n = 0.0, 0
            for g in grams(t):
                total, n = total + np.ones(len(g), np.float32) @ np.take(m.weights, g, axis=0), n + len(g)
            return m.judge(m.bias + total / n)

        for texts in batches:
            rows = [one(t) for at in range(0, len(texts), 256) for t in texts.slice(at, 256).to_pylist()]
            cols = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.float64(), pa.bool_()), strict=True)], names=["lang", "score", "ambiguous"])

    return docs.withColumn(out, F.arrow_udf(judged, "lang string, score double, ambiguous boolean")(F.col(text)))
