"""Toxicity and language against plain loops, and the bounds of their training samples."""

from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from pairloom.llm import common, language, toxicity

ODD = [None, "", " ", "123 !!", "One. Two!  Three?\nfour", "vile vile vile rat. fine day", "É à la VILE", "x" * 300 + ". rat", "rat.\n\n.\nday rat day"]


def _plain_toxicity(model, text):
    """1 - prod(1 - sigmoid(z)) over sentences, z from the distinct words and the distinct pieces of each word."""
    left = 1.0
    for sentence in re.split(r"(?<=[.!?])\s+|\n+", text or ""):
        words = set(re.findall(r"[^\W\d_]+", sentence.lower()))
        if not words:
            continue
        z = model.bias
        for w in words:
            marked = "^" + w + "$"
            pieces = {marked} | {marked[:n] for n in (4, 5, 6, 7)} | {w[i:i + 4] for i in range(len(w) - 3)}
            z += sum(model.weights[zlib.crc32(p.encode()) % toxicity.FEATURES] for p in pieces)
        left *= 1 - 1 / (1 + math.exp(-z))
    return 1 - left


def test_toxicity_equals_plain_noisy_or(spark):
    rng = random.Random(3)
    good, bad = ["day", "fine", "walk", "the", "house", "été"], ["vile", "rat", "scum"]
    make = lambda y: " ".join(rng.choice(good) for _ in range(9)) + ". " + " ".join(rng.choice(bad if y and i == 2 else good) for i in range(5))
    rows = [(i, make(i % 2), i % 2) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    texts = [*ODD, *[t for _, t, _ in rows[:60]]]
    got = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "n int, text string"), model, spans=False).collect()
    for r in got:
        assert abs(r.toxicity.score - _plain_toxicity(model, r.text)) < 1e-9, r
    assert got[5].toxicity.score > 0.5 > got[4].toxicity.score


def _plain_language(m, text):
    """Margins from all n-grams of bytes, one by one; the codeword of least weighted loss."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    letters = "".join(c if ord(c) > 127 or c.isalpha() else " " for c in text.lower())
    raw = (" " + " ".join(letters.split(" ")) + " ").encode()
    raw = re.sub(rb"[ \t\n\r\x0b\x0c]+", b" ", raw)
    total, n = np.zeros(len(m.bias)), 0
    for size in range(1, 6):
        for i in range(len(raw) - size + 1):
            h = 0
            for k, byte in enumerate(raw[i:i + size], 1):
                h = (h * 0x01000193 + byte + k) & 0xFFFFFFFF
            h = ((h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> 16
            total, n = total + m.weights[h], n + 1
    z = m.bias + total / n
    loss = [sum(t * math.log1p(math.exp(-c * x)) for c, x, t in zip(word, z, m.trust, strict=True)) for word in language.codewords(len(m.languages)).tolist()]
    p = [math.exp(min(loss) - x) for x in loss]
    best = loss.index(min(loss))
    return m.languages[best], p[best] / sum(p)


def test_language_equals_plain_decoding(spark):
    rng = random.Random(5)
    of = {"aa": ["tion", "the", "ing"], "bb": ["eau", "è", "qui"], "cc": ["ung", "ß", "sch"], "dd": ["ñ", "cion", "mente"]}
    rows = [(i, " ".join("".join(rng.choice(of[y]) for _ in range(2)) for _ in range(20)), y) for i, y in enumerate(list(of) * 40)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [*ODD, *[t for _, t, _ in rows[:40]]]
    got = language.detect(spark.createDataFrame(list(enumerate(texts)), "n int, text string"), model).collect()
    for r in got:
        lang, score = _plain_language(model, r.text)
        assert r.language.lang == lang and abs(r.language.score - score) < 1e-4, r
    assert [r.language.lang for r in got[len(ODD):]] == [y for _, _, y in rows[:40]]


def test_samples_hold_one_row_of_an_id_and_few_bytes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: seen.append((texts, labels)))
    monkeypatch.setattr(language, "fit", lambda texts, langs: seen.append((texts, langs)))
    docs = spark.createDataFrame([(1, f"hot text {i}", "en") for i in range(3000)] + [(i, f"text {i}", "fr") for i in range(2, 40)] + [(50, None, "en"), (None, "no id", "en")],
                                 "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, toxic int")
    toxicity.train(docs, labels)
    language.train(docs)
    assert len(seen[0][0]) == 39 and sum(t.startswith("hot") for t in seen[0][0]) == 1
    assert len(seen[1][0]) == 40 and sum(t.startswith("hot") for t in seen[1][0]) == 1
    monkeypatch.setattr(common, "SAMPLE_BYTES", 100)
    toxicity.train(docs, labels)
    assert 0 < sum(map(len, seen[2][0])) <= 100 and set(seen[2][0]) < set(seen[0][0])
    toxicity.train(docs.where("false"), labels)
    assert seen[3] == ([], [])


def test_repeated_ids_get_the_text_of_lowest_hash(spark):
    df = spark.createDataFrame([(1, t, 7) for t in "abcdef"] + [(2, None, 7)], "doc long, text string, h long")
    least = df.where("doc = 1").orderBy(F.xxhash64("text")).first().text
    assert [tuple(r) for r in common.one_text_each(df, ["doc"], ["h"]).collect()] == [(1, least, 7)]
