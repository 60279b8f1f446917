"""Whitening, substring dedup and cross-tokenizer alignment: against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict
from fractions import Fraction
from functools import reduce

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import alignment, contracts, substrings, whitening
from pairloom.llm.common import table

# ---- whitening


def _plain_whitening(vectors, weigh=True):
    """From exact fractions: n, sums, deviations, eigenvalues, and whitened rows by numpy on the exact covariance."""
    x = [tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in v) for v in vectors]
    fit = x if weigh else sorted(set(x))
    n, d = len(fit), len(x[0])
    sums = [sum(v[i] for v in fit) for i in range(d)]
    cov = np.array([[float(sum(Fraction(n * v[i] - sums[i], n) * Fraction(n * v[j] - sums[j], n) for v in fit) / n) for j in range(d)] for i in range(d)])
    values, axes = np.linalg.eigh(cov)
    y = np.array([[float(Fraction(n * v[i] - sums[i], n)) for i in range(d)] for v in x])
    dev = [sum((n * v[i] - sums[i]) ** 2 for i in range(d)) for v in x]
    return n, dev, values[::-1], (y @ axes / np.sqrt(np.maximum(values, 1e-300)))[:, ::-1], np.trace(cov)


@pytest.mark.parametrize("weights", ["count", "one"])
def test_whitening_equals_exact_arithmetic(spark, weights):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(60, 5)) * [3, 1, 0.5, 2, 1]).astype(np.float32)
    vectors = np.concatenate([vectors, np.repeat(vectors[:1], 30, axis=0), vectors[5:10]])
    odd = [None, [1.0, None, 0.0, 0.0, 0.0], [float("nan")] * 5, [float("inf"), 0.0, 0.0, 0.0, 0.0], [3e38, 0.0, 0.0, 0.0, 0.0], [1.0, 2.0], []]
    rows = [(i, v.tolist(), "w") for i, v in enumerate(vectors)] + [(900 + i, v, "w") for i, v in enumerate(odd)] + [(None, vectors[0].tolist(), "w")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, whitening string").repartition(7)
    got = whitening.whiten(df, components=4, weights=weights).collect()
    n, dev, values, white, trace = _plain_whitening([*vectors, vectors[0]], weights == "count")
    assert len(got) == len(vectors) + 1
    by_id = {r.vec_id: r.whitening for r in got}
    for i in range(len(vectors)):
        w = by_id[i]
        assert (w.n, w.deviation) == (n, dev[i])
        assert np.allclose(w.explained, values[:4] / trace, rtol=1e-9) and w.identity_error < 1e-9
        assert np.allclose(np.abs(w["values"]), np.abs(white[i][:4]), atol=1e-8)
    assert by_id[None] == by_id[0] == by_id[60]
    z = np.array([r.whitening["values"] for r in got])
    if weights == "count":
        assert np.allclose(np.cov(z.T, bias=True), np.eye(4), atol=1e-9)


def test_whitening_of_few_dimensions_and_empty_tables(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert [(r.whitening.n, r.whitening.deviation, r.whitening["values"]) for r in whitening.whiten(one).collect()] == [(2, 0, [])] * 2
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert {len(r.whitening["values"]) for r in whitening.whiten(line).collect()} == {1}
    huge = spark.createDataFrame([(i, [(-1.0) ** i * 1e16, 0.0]) for i in range(4)], "vec_id long, embedding array<double>")
    assert {r.whitening.deviation for r in whitening.whiten(huge).collect()} == {None}
    empty = whitening.whiten(line.where("false"))
    assert empty.count() == 0 and empty.schema.simpleString() == whitening.whiten(one).schema.simpleString()
    with pytest.raises(ValueError):
        whitening.whiten(one, weights="two")


def test_whitening_query_numbers_components(spark, small_dir):
    rows = contracts.QUERIES["op11_whitening"](spark, small_dir).collect()
    vectors = table(spark, small_dir, "embeddings").collect()
    assert len(rows) == 32 * len(vectors)
    assert Counter(r.component for r in rows) == dict.fromkeys(range(1, 33), len(vectors))
    z = defaultdict(dict)
    for r in rows:
        z[r.vec_id][r.component] = r.whitened
        assert r.n == len(vectors) and r.identity_error < 1e-4
    m = np.array([[c[k] for k in range(1, 33)] for c in z.values()])
    assert np.allclose(np.cov(m.T, bias=True), np.eye(32), atol=1e-8)
    share = {r.component: r.explained for r in rows}
    assert all(share[k] >= share[k + 1] for k in range(1, 32))


def test_partial_sums_meet_in_a_tree(spark):
    parts = spark.range(700).select(F.col("id").cast("int").alias("part"), F.col("id").alias("v"))

    def pack(batches):
        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.array([v, 1.0]).tobytes() for v in b.column(1).to_pylist()], pa.binary())], names=["part", "data"])

    assert whitening.tree_sum(parts.mapInArrow(pack, "part int, data binary")).tolist() == [700 * 699 / 2, 700]


# ---- substring dedup

def _plain_repeats(docs, window):
    """[(n_words, n_removed, kept)] by position; docs: (id, text)."""
    words = [brute.words(t) for _, t in docs]
    least: dict = {}
    rank = [float("inf") if i is None else i for i, _ in docs]
    for r, ws in zip(rank, words, strict=True):
        for s in range(len(ws) - window + 1):
            w = tuple(ws[s:s + window])
            least[w] = min(least.get(w, float("inf")), r)
    out = []
    for r, ws in zip(rank, words, strict=True):
        gone = {s + j for s in range(len(ws) - window + 1) if least[tuple(ws[s:s + window])] < r for j in range(window)}
        kept = [w for i, w in enumerate(ws) if i not in gone]
        out.append((len(ws), len(gone), " ".join(kept)))
    return out


@pytest.mark.parametrize("window,shortest", [(1, 12), (7, 2), (20, 3), (50, 12), (13, 12)])
def test_repeated_passages_equal_brute_force(spark, window, shortest):
    rng = random.Random(window)
    vocabulary = [f"w{i}" for i in range(12)] + ["Éa", "x\x85y"]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = [make(rng.randrange(window, 4 * window)) for _ in range(6)]
    texts: list = [None, "", " \n ", "one"]
    for _ in range(90):
        parts = [make(rng.randrange(0, 2 * window + 3)) for _ in range(rng.randrange(1, 4))]
        if rng.random() < 0.6:
            p = rng.choice(shared)
            at = rng.randrange(0, len(p))
            parts.insert(rng.randrange(len(parts) + 1), p[at:at + rng.randrange(window // 2, 2 * window + 2)] if rng.random() < 0.5 else p)
        texts.append(rng.choice([" ", "\n", "\t "]).join(w for p in parts for w in p))
    base = make(6 * window)
    for _ in range(25):  # near copies
        copy = list(base)
        copy[rng.randrange(len(copy))] = "other"
        texts.append(" ".join(copy))
    texts += [texts[10]] * 30 + [" ".join(base)] * 3 + [" ".join(["a"] * (3 * window))] * 2 + [" ".join(["a"] * (2 * window + 1)), " ".join(["a", "b"] * window * 2)]
    ids: list = list(range(len(texts)))
    rng.shuffle(ids)
    docs = list(zip(ids, texts, strict=True)) + [(ids[20], texts[20]), (ids[20], texts[21]), (None, texts[30]), (None, texts[30]), (None, " ".join(make(3 * window)))]
    df = spark.createDataFrame([(i, t, n, "w") for n, (i, t) in enumerate(docs)], "doc_id long, text string, n int, repeats string").repartition(5)
    got = {r.n: (r.repeats.n_words, r.repeats.n_removed, r.repeats.kept_text) for r in substrings.remove_repeats(df, window=window, shortest=shortest).collect()}
    want = _plain_repeats(docs, window)
    assert got == dict(enumerate(want))
    assert sum(w[1] for w in want) > 0


def test_repeats_with_joins_in_place_of_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BROADCAST_BYTES", 0)
    rng = random.Random(1)
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(f"d{i:03}", " ".join(f"{rng.randrange(10**6)}" for _ in range(70)) + (" " + passage if i % 3 else "")) for i in range(60)]
    docs += [(f"e{i:03}", docs[0][1]) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id string, text string")
    got = {r.doc_id: r.repeats.n_removed for r in substrings.remove_repeats(df).collect()}
    assert got == {i: 60 if i[0] == "d" and int(i[1:]) % 3 and i != "d001" else 70 if i[0] == "e" else 0 for i, _ in docs}
    assert substrings.remove_repeats(df.where("false")).count() == 0


def test_levels_double():
    assert substrings.levels(50) == [13, 25, 50]
    assert substrings.levels(8) == [8] and substrings.levels(400) == [13, 25, 50, 100, 200, 400]


def test_odd_documents_lose_nothing(spark, odd_docs):
    rows = substrings.remove_repeats(odd_docs).collect()
    want = _plain_repeats([(r.doc_id, r.text) for r in rows], 50)
    assert [(r.repeats.n_words, r.repeats.n_removed, r.repeats.kept_text) for r in rows] == want


# ---- alignment

@pytest.fixture(scope="module")
def coder():
    import public_tokenizers
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as a, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        return alignment.Coder(a.read(), b.read())


def _plain_tokens(coder, text):
    """Ids of both tokenizers for the whole text, or empty lists."""
    if not text:
        return [], []
    a, b = coder.a.encode(" " + text, add_special_tokens=False).ids, coder.b.encode(text)
    raw = (" " + text).encode()
    good = all(b"".join(t[i] for i in ids) == raw for t, ids in ((coder.a_bytes, a), (coder.b_bytes, b)))
    return (a, b) if good else ([], [])


def _plain_alignment(coder, texts):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, groups) by walking both token lists."""
    out, links = [], []
    for text in texts:
        a, b = _plain_tokens(coder, text)
        ends, groups, of = {}, [], []
        at = 0
        for i in a:
            at += len(coder.a_bytes[i])
            ends[at] = i
        at, j, start, done = 0, 0, 0, 0
        a_at, k = 0, 0
        for i in b:
            at += len(coder.b_bytes[i])
            j += 1
            if at in ends:
                of.append((ends[at], i))
                ga = []
                while a_at < at:
                    ga.append(a[k])
                    a_at += len(coder.a_bytes[a[k]])
                    k += 1
                groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, b[done:j])))
                done = j
        out.append((len(a), len(b), len(groups), ";".join(groups)))
        links.append(of)
    count = Counter(p for of in links for p in of)
    best: dict = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return [(*o[:3], len(of), sum(count[p] == best[p[1]] for p in of), sum(count[p] for p in of), o[3]) for o, of in zip(out, links, strict=True)]


TRICKY = ["a  b c ", " lead", "x\n\ny\nz  \n w", "tab\there \t and", "<|endoftext|> <s> </s><unk> <0x41>", "mark ▁ here", "日本語 のテキスト、漢字。", "naïve café é ́x", "\U0001f389\U0001f468‍\U0001f469 ok",
          "a b　c   d", "don't they'll I'M 'tis ' s", "1234567 12 3.14 $5", "\x00\x01 ctrl\x7f", "word\x85next  line", "\n", " ", "a", "é", "﻿bom ​zero", "Привет мир\nновая строка", "end\n", "a \n b", "a\n b", "a \nb"]


def _random_text(rng, n):
    alphabet = ["the", "tion", "é", " ", " ", " ", "\n", "  ", ".", ",", "'s", "12", "日本", "\U0001f389", "\t", "ab", " ", "X", "-"]
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_words_encoded_apart_equal_the_whole_text(coder):
    rng = random.Random(4)
    texts = TRICKY + [_random_text(rng, rng.randrange(1, 60)) for _ in range(1500)]
    for text, found in zip(texts, coder.fragments([" " + t for t in texts]), strict=True):
        a, b = _plain_tokens(coder, text)
        n_a, n_b, *_ = alignment.finish(found)
        assert (n_a, n_b) == (len(a), len(b)), repr(text)


@pytest.mark.parametrize("chunk_bytes", [1, 40, 1 << 16])
def test_alignment_equals_walking_both_lists(spark, coder, chunk_bytes):
    import public_tokenizers
    rng = random.Random(9)
    texts = [None, "", *TRICKY, *[_random_text(rng, rng.randrange(1, 300)) for _ in range(40)], "the heat of the day\nand more " * 150]
    texts += [texts[-1]] * 5 + ["long ▁ mark " * 30]
    df = spark.createDataFrame([(i, t, "w") for i, t in enumerate(texts)], "doc_id long, text string, alignment string").repartition(4)
    aligned = alignment.align(df, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), chunk_bytes=chunk_bytes, groups=True)
    counts = alignment.pair_counts(aligned)
    want = _plain_alignment(coder, texts)
    for limit in (1 << 20, 0):
        got = alignment.score_links(aligned, counts, limit).collect()
        assert len(got) == len(texts)
        for r in got:
            x = r.alignment
            assert (x.n_a, x.n_b, x.n_groups, r.n_links, r.n_best, r.count_sum, x.groups) == want[r.doc_id], (r.doc_id, texts[r.doc_id])
            assert x.groups_sha256 == (hashlib.sha256(x.groups.encode()).hexdigest() if x.n_a else "")


def test_fragments_join_associatively_at_any_bytes(coder):
    """Byte ranges that cut tokens and groups: any bracketing of the fragments gives the fragment of the whole."""
    rng = random.Random(2)
    for _ in range(150):
        text = _random_text(rng, rng.randrange(2, 60))
        a, b = (np.array(x, "<u4") for x in _plain_tokens(coder, text))
        if not len(a):
            continue
        ends = [np.cumsum(s[x]) for s, x in ((coder.a_size, a), (coder.b_size, b))]
        cuts = sorted({0, int(ends[0][-1]), *(rng.randrange(int(ends[0][-1]) + 1) for _ in range(rng.randrange(8)))})
        parts = []
        for lo, hi in zip(cuts, cuts[1:]):
            (p, q), (r, s) = (np.searchsorted(e, [lo, hi], "right") for e in ends)
            parts.append(alignment.fragment(a[p:q], b[r:s], ends[0][p:q], ends[1][r:s], coder.names))
        whole = alignment.fragment(a, b, *ends, coder.names)
        left = reduce(alignment.join, parts)
        right = reduce(lambda y, x: alignment.join(x, y), parts[::-1])
        k = rng.randrange(len(parts) + 1)
        middle = alignment.join(reduce(alignment.join, parts[:k], alignment.EMPTY), reduce(alignment.join, parts[k:], alignment.EMPTY))
        for got in (left, right, middle):
            for field, x, y in zip(got._fields, got, whole, strict=True):
                assert np.array_equal(x, y) if isinstance(x, np.ndarray) else x == y, field


def test_chunks_are_the_text(coder):
    rng = random.Random(7)
    for size in (1, 5, 30):
        for _ in range(200):
            text = _random_text(rng, rng.randrange(1, 80))
            parts = alignment.chunks_of(text, size)
            assert "".join(parts) == " " + text and all(parts)
            whole = [_x for p in parts for _x in alignment.words_of(p)]
            assert whole == alignment.words_of(" " + text)


def test_alignment_query(spark, small_dir, coder):
    rows = {r.doc_id: r for r in contracts.QUERIES["op13_alignment"](spark, small_dir).collect()}
    docs = table(spark, small_dir, "documents").select("doc_id", "text").collect()
    want = _plain_alignment(coder, [d.text for d in docs])
    for d, w in zip(docs, want, strict=True):
        r = rows[d.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == w[:6]
        assert r.groups_sha256 == (hashlib.sha256(w[6].encode()).hexdigest() if w[0] else "")
