"""Merge learning, text repair, decoding and position ids against plain loops and hand tables."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pairloom.functions import text as T
from pairloom.operators import pooling as PL
from pairloom.operators import tokens as TK
from pairloom.plans import q_text
from pairloom.session import load


def _merged(word, pair):
    out, i = [], 0
    while i < len(word):
        if tuple(word[i:i + 2]) == pair:
            out.append(word[i] + word[i + 1])
            i += 2
        else:
            out.append(word[i])
            i += 1
    return out


def _plain_merges(words: Counter, n: int):
    """One merge at a time, every pair counted anew from all words."""
    symbol = dict(T.byte_table())
    state = []
    for w, c in words.items():
        s = [symbol[b] for b in w.encode()]
        if s:
            s[-1] += "</w>"
            state.append((s, c))
    merges = []
    while len(merges) < n:
        counts: Counter = Counter()
        for s, c in state:
            for p in set(zip(s, s[1:])):
                counts[p] += c
        if not counts:
            break
        best = min(counts.items(), key=lambda x: (-x[1], x[0]))[0]
        merges.append(best)
        state = [(_merged(s, best), c) for s, c in state]
    return merges


def _learned(df, n):
    return [(r.left, r.right) for r in TK.learn_merges(df, n).orderBy("rank").collect()]


@pytest.mark.parametrize("seed,alphabet,n", [(1, "ab", 40), (2, "abc", 60), (3, "aé", 30), (4, "abcdefgh", 120), (5, "a", 12)])
def test_learned_merges_equal_one_at_a_time(spark, monkeypatch, seed, alphabet, n):
    monkeypatch.setattr(TK, "RESTATE", 3)
    monkeypatch.setattr(TK, "TOP_PAIRS", 40)
    monkeypatch.setattr(TK, "BLOCK_WORDS", 16)
    rng = random.Random(seed)
    words = Counter()
    for _ in range(60):
        words["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 9)))] += rng.randrange(1, 6)
    rows = [(w,) for w, c in words.items() for _ in range(c)]
    df = spark.createDataFrame(rows + [("",)], "token string").repartition(3)
    assert _learned(df, n) == _plain_merges(words, n)


def test_no_words_no_merges(spark):
    assert _learned(spark.createDataFrame([("a",), ("",)], "token string"), 5) == []
    assert _learned(spark.createDataFrame([], "token string"), 5) == []


def test_deep_merges_reach_encode_and_decode(spark, small_dir):
    docs = load(spark, small_dir, "documents")
    merges = TK.merge_list(q_text.f_merges(spark, small_dir))
    depth: dict = defaultdict(int)
    for a, b in merges:
        depth[a + b] = max(depth[a + b], 1 + max(depth[a], depth[b]))
    pieces = TK.vocab_pieces(merges)
    ids = {i for r in TK.encode(docs, "doc_id", "text", merges).select("ids").collect() for i in r.ids}
    assert max(depth[pieces[i]] for i in ids) >= 4
    back = TK.encode(docs, "doc_id", "text", merges).select("doc_id", TK.decode_column(merges)(F.col("ids")).alias("t"))
    want = {r.doc_id: "".join(t + " " for t in r.tokens) for r in TK.tokenize(docs, "doc_id", "text").collect()}
    assert {r.doc_id: r.t for r in back.collect()} == want


def test_decode_of_null_empty_and_broken_bytes(spark):
    dec = TK.decode_column([("t", "h")])
    pieces = TK.vocab_pieces([("t", "h")])
    ids = {p: i for i, p in enumerate(pieces)}
    symbol = dict(T.byte_table())
    df = spark.createDataFrame([(1, None), (2, []), (3, [ids["th"], ids["e</w>"]]), (4, [ids[symbol[0xC3]], ids["a</w>"]])], "n int, ids array<long>")
    assert {r.n: r.t for r in df.select("n", dec(F.col("ids")).alias("t")).collect()} == {1: None, 2: "", 3: "the ", 4: "�a "}


HAND = {
    "Itâ€™s": "It’s",                      # windows-1252
    "Ã©tÃ©": "été",              # latin-1
    "ÃƒÂ©": "é",                      # two levels
    "ÐŸÑ€Ð¸Ð²ÐµÑ‚": "Привет",
    "ðŸ˜€ ok": "\U0001f600 ok",
    "naÃ¯ve &amp;amp; cafÃ©": "naïve & café",
    "â€œquotedâ€\u009d": "“quoted”",
    "ä¸­æ–‡": "中文",
}
CLEAN = ["", "plain", "CAFÉ…", "VOILÀ”", "Été à Âge «É»", "100 € ™", "Über Ø ß… é…", "Привет 中文 \U0001f600", "Ã ©"]


def test_text_repair_by_hand(spark):
    df = spark.createDataFrame([(t,) for t in [*HAND, *CLEAN, None]], "t string")
    got = {r.t: r.c for r in df.select("t", T.basic_clean(F.col("t")).alias("c")).collect()}
    assert got == HAND | {t: t for t in CLEAN} | {None: None}
    for t in [*HAND.values(), *CLEAN]:
        assert T.repair(t) == t
    for t in HAND:
        assert T.repair(T.repair(t)) == T.repair(t)


@pytest.mark.parametrize("encoding", ["latin-1", "cp1252"])
def test_repair_undoes_any_number_of_levels(encoding):
    for text in ("café à la crème", "Москва", "it’s — fine", "日本語"):
        broken = text
        for _ in range(3):
            try:
                broken = broken.encode("utf-8").decode(encoding)
            except UnicodeDecodeError:
                break
            assert T.repair(broken) == text


def test_position_ids_of_long_and_odd_arrays(spark):
    rng = random.Random(1)
    rows = [(0, None), (1, []), (2, [1, 1]), (3, [5, 1, 7, None, 9])] + [(4, [rng.choice([1, 5, 6]) for _ in range(200_000)])]
    df = spark.createDataFrame(rows, "n int, ids array<long>").repartition(2)

    def plain(ids):
        out, n = [], 1
        for x in ids:
            n += x is not None and x != 1
            out.append(n if x is not None and x != 1 else 1)
        return out

    got = {r.n: r.p for r in df.select("n", PL.position_ids_array("ids", 1).alias("p")).collect()}
    assert got == {n: None if ids is None else plain(ids) for n, ids in rows}


def test_published_files_are_read_to_a_line(spark, tmp_path):
    from pairloom.sources.readers import read_merges
    (tmp_path / "m.txt").write_text("#version\na b\nab c\nc d</w>\n")
    assert [(r.rank, r.left, r.right) for r in read_merges(spark, str(tmp_path / "m.txt"), most=2).collect()] == [(0, "a", "b"), (1, "ab", "c")]
    assert read_merges(spark, str(tmp_path / "m.txt")).count() == 3
