"""Toxicity by multiple-instance learning (3): labels are of documents, scores of sentences.

A sentence's probability is a logistic function of its words, and a document's is the noisy-or of its sentences:
one offending sentence is enough. Training sees only document labels; the sentence scores then locate the offence.
A word adds the weights of its hashed features (itself, its beginnings, its character 4-grams), so unseen inflections count.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, fit_sample, one_text_each

FEATURES = 1 << 18
#: Bounds of the training sample: so many labelled documents of each class, the smallest by hash of their id.
SAMPLE = {1: 2000, 0: 4000}
EPOCHS, SCREEN = 300, 60
_BREAK = re.compile(r"(?<=[.!?])\s+|\n+")
_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[int]:
    """Hashed features of a lower-case word."""
    marked = f"^{word}$"
    grams = dict.fromkeys([marked, marked[:4], marked[:5], marked[:6], marked[:7], *[word[i:i + 4] for i in range(len(word) - 3)]])
    return [zlib.crc32(g.encode()) % FEATURES for g in grams]


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of the pieces between sentence ends and line ends that hold a letter; code points."""
    out, at = [], 0
    text = text or ""
    for stop, after in [(m.start(), m.end()) for m in _BREAK.finditer(text)] + [(len(text), len(text))]:
        if _WORD.search(text, at, stop):
            out.append((at, stop))
        at = after
    return out


def tokens(sentence: str) -> list[str]:
    """The distinct words of a sentence: a word repeated a hundred times offends once."""
    return list(dict.fromkeys(_WORD.findall(sentence.lower())))


class Model:
    """bias and weights; scores inside tasks with a bounded memory of word scores."""

    def __init__(self, bias: float, weights: np.ndarray):
        self.bias, self.weights = bias, weights

    def scorer(self):
        table, bias = self.weights.tolist(), self.bias
        known = Memo(lambda w: sum([table[i] for i in features(w)]), 500_000)

        def logits(text: str | None) -> list[tuple[int, int, float]]:
            return [(a, b, bias + sum(map(known.__getitem__, tokens(text[a:b])))) for a, b in sentences(text)]
        return logits


def noisy_or(logits: list[float]) -> float:
    """1 - prod(1 - sigmoid(z)), without cancellation; no sentences: 0."""
    return float(-np.expm1(-np.logaddexp(0.0, np.array(logits)).sum())) if logits else 0.0


def fit(texts: list[str | None], labels: list[int], epochs: int = EPOCHS, rate: float = 1.0, l1: float = 0.5, min_uses: int = 3) -> Model:
    """Proximal Adagrad over the whole sample; with one class only, a constant model.

    Invented and rare words abound, so the penalty is L1 (few features keep a weight), and a feature needs ``min_uses``
    (document, word) uses. After ``SCREEN`` rounds the features without a weight are left out.
    """
    if len(set(labels)) < 2:
        return Model(20.0 if labels and labels[0] else -20.0, np.zeros(FEATURES))
    words: dict[str, int] = {}
    feat, ends = array("i"), array("q", [0])
    flat, starts, doc_starts, kept = array("i"), array("q"), array("q"), array("i")
    uses = array("i")
    for text, y in zip(texts, labels, strict=True):
        spans = sentences(text)
        if not spans:
            continue
        doc_starts.append(len(starts))
        kept.append(y)
        seen: set[int] = set()
        for a, b in spans:
            starts.append(len(flat))
            for w in tokens(text[a:b]):
                if w not in words:
                    words[w] = len(words)
                    feat.extend(features(w))
                    ends.append(len(feat))
                    uses.append(0)
                flat.append(words[w])
                seen.add(words[w])
        for i in seen:
            uses[i] += 1
    if len(set(kept)) < 2:
        return Model(-20.0, np.zeros(FEATURES))
    flat, feat, uses = (np.frombuffer(x, np.int32) for x in (flat, feat, uses))
    starts, doc_starts, ends, y = *(np.frombuffer(x, np.int64) for x in (starts, doc_starts, ends)), np.frombuffer(kept, np.int32)
    of = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(ends))
    used = np.bincount(feat, uses[of], FEATURES)[feat] >= min_uses
    feat, of = feat[used], of[used]
    sent_of = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(np.r_[starts, len(flat)]))
    doc_of = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(np.r_[doc_starts, len(starts)]))
    w, bias, sum_w, sum_b = np.zeros(FEATURES), -4.0, np.ones(FEATURES), 1.0
    for epoch in range(epochs):
        if epoch == SCREEN:
            live = w[feat] != 0
            feat, of = feat[live], of[live]
        word = np.bincount(of, w[feat], len(words))
        z = bias + np.add.reduceat(word[flat], starts)
        total = np.add.reduceat(np.logaddexp(0, z), doc_starts)
        p = -np.expm1(-total)
        # d loss / d z: sigmoid(z) for clean documents, -(1 - P) / P * sigmoid(z) for offending ones
        pull = np.where(y == 1, -np.minimum((1 - p) / np.maximum(p, 1e-9), 1e3), 1.0)
        g = pull[doc_of] / (1 + np.exp(-np.clip(z, -50, 50)))
        grad = np.bincount(feat, np.bincount(flat, g[sent_of], len(words))[of], FEATURES)
        sum_w += grad * grad
        sum_b += g.sum() ** 2
        step = rate / np.sqrt(sum_w)
        w -= step * grad
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        bias -= rate * g.sum() / np.sqrt(sum_b)
    return Model(float(bias), w)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic",
          sample: dict[int, int] | None = None) -> Model:
    """Fit on the bounded sample; several labels of one document count as their largest, null ids, texts and labels not at all.

    Of several rows of one id the text of lowest hash counts. Documents come in the order of a hash of their ids, as many as
    ``sample`` names for each label, and not beyond ``SAMPLE_BYTES`` of text. Empty tables give a model that scores 0.
    """
    sample = sample or SAMPLE
    marks = (labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_col).alias("_llm_id"))
             .agg(F.max(F.col(label).cast("int")).alias("_llm_y")).withColumn("_llm_h", F.xxhash64(F.lit(7), "_llm_id")))
    pick = None
    for y, n in sample.items():
        part = marks.where(F.col("_llm_y") == y).orderBy("_llm_h", "_llm_id").limit(n)
        pick = part if pick is None else pick.unionByName(part)
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text).alias("text")).join(F.broadcast(pick), F.col("doc") == F.col("_llm_id"))
    return fit_sample(one_text_each(rows, ["doc"], ["_llm_y", "_llm_h"]), "_llm_y", fit)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "toxicity", spans: bool = True) -> DataFrame:
    """Add the struct ``out`` to every row: score (0 to 1) and, if ``spans``, the offending sentences (start, end, score), score >= 0.5.

    Texts that are null, empty or without letters score 0. Repeated rows score alike, an empty table gives an empty table,
    other columns pass through (one named ``out`` is replaced).
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))
    offence = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    kind = "score double" + ", spans array<struct<start:bigint,end:bigint,score:double>>" * spans

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        logits = Model(*shared.value).scorer()
        for texts in batches:
            scores, found = [], []
            for at in range(0, len(texts), 256):
                for t in texts.slice(at, 256).to_pylist():
                    zs = logits(t)
                    scores.append(noisy_or([z for _, _, z in zs]))
                    found.append([{"start": a, "end": b, "score": float(1 / (1 + np.exp(-z)))} for a, b, z in zs if z >= 0])
            cols = [pa.array(scores, pa.float64())] + [pa.array(found, pa.list_(offence))] * spans
            yield pa.StructArray.from_arrays(cols, names=["score", "spans"][: len(cols)])

    return docs.withColumn(out, F.arrow_udf(scored, kind)(F.col(text)))
