"""BPE, token counts, PII, quality rules, fingerprints: against brute force and the public library."""

from __future__ import annotations

import hashlib
import random

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairloom.llm import bpe, contracts, fingerprint, pii, quality, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_bpe_equals_library(odd_docs, library):
    rows = bpe.encode(odd_docs, PATH, decoded=True, digests=True).select("text", "bpe.*", "quality").collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert (r.ids, r.n_tokens) == (want, len(want))
        assert r.decoded == library.decode(want, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


def test_bpe_random_words(library):
    rng = random.Random(3)
    coder = bpe.Coder(bpe.BpeTable(PATH))
    letters = "abcdeth inghe THEéèÉßΣςİ'sİ́ \n\t1２3,.!?🎉日本語한글\x1c\x85\xa0՘ <|endoftext|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(600)]
    texts += ["a" * n for n in range(1, 40)] + ["x<|endoftext|>y<|startoftext|>", "ha" * 500]
    for t, raw in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_bpe_merges_one_at_a_time_where_ranks_are_not_ordered():
    table = bpe.BpeTable(PATH)
    words = [b"banana", b"aaaaaaa", b"the", b"thethethe", b"x"]
    fast = [x.tolist() for x in bpe.merge_words(words, table)]
    table.stable = False
    assert [x.tolist() for x in bpe.merge_words(words, table)] == fast


def test_decode_operator(spark, library):
    ids = library.encode("Hello worlds", add_special_tokens=False).ids
    rows = bpe.decode(spark.createDataFrame([(ids,), ([],), (None,)], "ids array<int>"), PATH).collect()
    assert [r.decoded for r in rows] == [library.decode(ids, skip_special_tokens=False), "", ""]
    assert bpe.Coder(bpe.BpeTable(PATH)).text_of(np.array(ids)).strip() == "hello worlds"


def greedy(word, initial, continuation):
    n, at = 0, 0
    while at < len(word):
        pieces = initial if at == 0 else continuation
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        n, at = n + 1, end
    return n


def test_automaton_equals_greedy_matching():
    rng = random.Random(1)
    for _ in range(60):
        word = lambda n: bytes(rng.choice(b"ab") for _ in range(rng.randint(1, n)))
        initial, continuation = ({word(5) for _ in range(rng.randint(1, 8))} for _ in range(2))
        a = token_counts.Automaton(initial, continuation)
        for _ in range(60):
            w = word(14)
            assert a.count(w) == greedy(w, initial, continuation), (initial, continuation, w)


def test_token_counts_of_texts(odd_docs):
    initial, continuation = token_counts.byte_level_pieces(public_tokenizers.path("byte_bpe_50k.json"))
    rows = token_counts.count_tokens(odd_docs, token_counts.Automaton(initial, continuation)).select("text", "tokens.*").collect()
    initial, continuation = set(initial), set(continuation)
    for r in rows:
        ws = [w.encode() for w in brute.words(r.text)]
        assert r.n_words == len(ws)
        if len(ws) < 1000:
            assert r.n_tokens == sum(greedy(w, initial, continuation) for w in ws)


def marked_greedy(word, vocab):
    """Tokens of the space mark and the word, longest piece of the whole vocabulary first."""
    chars = bpe.byte_chars()
    marked, n, at = "".join(chars[b] for b in b" " + word), 0, 0
    while at < len(marked):
        at = next(e for e in range(len(marked), at, -1) if marked[at:e] in vocab)
        n += 1
    return n


def test_token_counts_of_all_scripts(spark, tmp_path):
    vocab = token_counts._vocabulary(contracts.vocabulary("byte_bpe_50k.json"))
    texts = ["работает страна только привет Язык", "中国人民共和国成立 国中人民共和国成立 不 人 日本語", "한국어 안녕하세요", "հայերեն", "สวัสดีครับ ภาษาไทย",
             "🎉 🎉🎉x \x7f\U000e0001 é ñandú ا עברית हिन्दी", "plain words, 1234 and (signs)", "", None]
    rng = random.Random(6)
    texts += [" ".join("".join(chr(rng.choice([rng.randrange(33, 0xD800), rng.randrange(0xE000, 0x20000)])) for _ in range(rng.randint(1, 9))) for _ in range(50))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in contracts.QUERIES["op4_token_counts"](spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        ws = [w.encode() for w in brute.words(t)]
        assert (got[i].n_words, got[i].n_tokens) == (len(ws), sum(marked_greedy(w, vocab) for w in ws)), t


def test_automaton_with_a_lone_mark():
    rng = random.Random(7)
    for _ in range(60):
        word = lambda n: bytes(rng.choice(b"ab") for _ in range(rng.randint(1, n)))
        initial, continuation = ({word(5) for _ in range(rng.randint(1, 4))} for _ in range(2))
        continuation |= {b"a", b"b"}
        chars = bpe.byte_chars()
        vocab = {"".join(chars[b] for b in p) for p in [b" ", *(b" " + p for p in initial), *continuation]}
        a = token_counts.Automaton(initial, continuation, lone_mark=True)
        for _ in range(60):
            w = word(14)
            assert a.count(w) == marked_greedy(w, vocab), (initial, continuation, w)


def test_pii_base_spans(odd_docs, spark):
    more = ["1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7", "4" * 16, "+1 23 45 67 89 0 1 2 3 4 5 6 7 8", "+1((((((", "x@y@z.de, é@é.fr 日本 q.r+s@t-u.v.w-.", "1.2.3", "01.002.0003.255",
            "1.1.1.99999999999999999999", "a@b.c" * 50, "4111111111111111 " * 300, ".@a.b", "+12345678+12345678"]
    docs = odd_docs.select("text").union(spark.createDataFrame([(t,) for t in more], "text string"))
    for r in pii.find_pii(docs).collect():
        want = [(k, a, b) for k, v in brute.base_spans(r.text).items() for a, b in v]
        assert [(s.kind, s.start, s.end) for s in r.pii if s.base] == want
        assert all((r.text[s.start:s.end]) == s.value and 0.6 <= s.score <= 1 for s in r.pii)


def test_pii_added_spans_and_redaction(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00 ok", "DE89370400440532013001", "ssn 123-45-6789", "123-45-6789", "visa 378282246310005", "378282246310005",
             "a@b.co and 10.0.0.1, +1 (219) 555-0563.", None, "nothing"]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    kinds = {r.i: [s.kind for s in r.pii] for r in pii.find_pii(docs).collect()}
    assert kinds == {0: ["iban"], 1: [], 2: ["ssn"], 3: [], 4: ["card"], 5: [], 6: ["email", "ip", "phone"], 7: [], 8: []}
    clean = {r.i: r.text for r in pii.redact(docs).collect()}
    assert clean == {0: "IBAN <IBAN> ok", 1: texts[1], 2: "ssn <SSN>", 3: texts[3], 4: "visa <CARD>", 5: texts[5],
                     6: "<EMAIL> and <IP>, <PHONE>.", 7: None, 8: "nothing"}


def test_iban_ends_with_its_number(spark):
    bare = ["DE89370400440532013000", "GB29NWBK60161331926819", "NO9386011117947", "FR1420041010050500013M02606", "BE68539007547034", "CH9300762011623852957",
            "MT84MALT011000012345MTLCAST001S", "ES9121000418450200051332"]
    ibans = bare + [" ".join(x[i:i + 4] for i in range(0, len(x), 4)) for x in bare]
    behind = ["", " Bitte zahlen", " BIC COBADEFF", " BIC: COBADEFFXXX", " 2024-01-01", " 5", " A", ".", "\nUND", " DE", f" {bare[0]}", f" {ibans[8]} OK"]
    texts = [f"{before}{x}{b}" for before in ("", "Konto AB12 ", "IBAN: ") for x in ibans for b in behind]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    wanted = [[x] + [y for y in (bare[0], ibans[8]) if b.startswith(" " + y)] for _ in range(3) for x in ibans for b in behind]
    for r in pii.find_pii(docs).collect():
        assert [s.value for s in r.pii if s.kind == "iban"] == wanted[r.i], r.text
    for r in pii.redact(docs).collect():
        assert r.text.count("<IBAN>") == len(wanted[r.i]) and not any(x in r.text for x in ibans), texts[r.i]
    wrong = ["DE89370400440532013000X", "XDE89370400440532013000", "DE8937040044053201300", "DE88370400440532013000 Bitte", "GB29NWBK60161331926818"]
    assert all(not r.pii for r in pii.find_pii(spark.createDataFrame([(t,) for t in wrong], "text string")).collect())


def test_pii_stays_in_sql(odd_docs):
    plan = pii.redact(pii.find_pii(odd_docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_quality_statistics(odd_docs):
    rows = quality.quality(odd_docs.drop("quality")).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        q = r.quality
        if len(r.text or "") < 20_000:
            assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == brute.quality(r.text)
        assert q.clean_text == r.text and q.kept != q.base_failed


def test_boilerplate_goes_and_copies_stay(spark):
    words = lambda seed, n: " ".join("".join(random.Random(f"{seed}-{j}").choices("abcdefgh", k=9)) for j in range(n))
    banner = "Subscribe to our NEWSLETTER number 7 today please"
    docs = [(i, f"{words(i, 30)}\n{banner.replace('7', str(i))}\n{words(-i - 1, 20)}", "h") for i in range(60)]
    docs += [(100 + i, f"{banner}\n{words(1000 + i, 5)}", "h") for i in range(30)]  # little but the banner
    copy = f"{words('c', 15)}\n{words('d', 15)}"
    docs += [(200 + i, copy, "h") for i in range(100)]
    docs += [(400 + i, f"{banner}\n{words(2000 + i, 5)} and six more words", None) for i in range(15)]  # too few documents of this host
    got = {r.doc_id: r.quality for r in quality.quality(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert all(got[i].kept and got[i].n_removed_lines == 1 and got[i].n_left_words == 50 and "NEWS" not in got[i].clean_text for i in range(60))
    assert not any(got[100 + i].kept for i in range(30))
    assert all(got[200 + i].kept and got[200 + i].clean_text == copy for i in range(100))
    assert all(got[400 + i].kept and got[400 + i].n_removed_lines == 0 for i in range(15))


def test_boilerplate_blocks_go_and_a_refrain_stays(spark):
    words = lambda seed, n: " ".join("".join(random.Random(f"{seed}-{j}").choices("abcdefgh", k=9)) for j in range(n))
    header, footer = "site name and logo\nhome news sport weather", "terms of this site\nall rights are reserved here\nimprint and contact"
    docs = [(i, f"{header}\n{words(i, 30)}\n{footer}", "h") for i in range(60)]
    docs += [(100 + i, f"{header}\n{words(1000 + i, 5)}\n{footer}", "h") for i in range(30)]  # little but the block
    song = "\n".join(f"{words(('song', i), 6)}\nand so we sing again" for i in range(30))
    docs += [(200, song, "h")]
    got = {r.doc_id: r.quality for r in quality.quality(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert all(got[i].kept and got[i].n_removed_lines == 5 and got[i].clean_text == words(i, 30) for i in range(60))
    assert not any(got[100 + i].kept for i in range(30))
    assert got[200].n_removed_lines == 0 and got[200].clean_text == song


@pytest.mark.parametrize("limit", [quality.BROADCAST_BYTES, -1])
def test_boilerplate_of_a_large_host(spark, monkeypatch, limit):
    monkeypatch.setattr(quality, "BROADCAST_BYTES", limit)
    words = lambda seed, n: " ".join("".join(random.Random(f"{seed}-{j}").choices("abcdefgh", k=9)) for j in range(n))
    docs = [(i, words(i, 12) + "\nfooter of few pages" * (i < 25) + "\nfooter of twenty" * (i < 20), host) for i in range(1200) for host in ("h", None)]
    docs += [(2000, "", "h"), (2001, None, "h"), (2002, None, None), (2003, words(0, 12), "other")] + [(2004, words(1, 12) + "\nfooter of few pages\nfooter of twenty", "h")] * 40
    rows = quality.quality(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    assert len(rows) == len(docs)
    for r in rows:
        marked = r.doc_id < 25 or r.doc_id == 2004
        assert r.quality.n_removed_lines == marked, r
        assert r.quality.clean_text == (r.text.replace("\nfooter of few pages", "") if marked else r.text)


def test_fingerprints():
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(5000)}" for _ in range(600)).encode()
    other = " ".join(f"v{rng.randrange(5000)}" for _ in range(600)).encode()
    near = text[:1500] + b"INSERTED" + text[1500:]
    a, b, c, d = fingerprint.fingerprints([text, near, other, text])
    assert a == d and fingerprint.likeness([a, a, a], [d, b, c])[0] == 1.0
    _, close, far = fingerprint.likeness([a, a, a], [d, b, c])
    assert close > 0.8 and far < 0.2
    # alone or in a batch, a text has the same fingerprint; empty and uniform texts have one too
    for t in (text, b"", b"a", b"a" * 5000, near, bytes(range(256)) * 9):
        assert fingerprint.fingerprints([t]) == fingerprint.fingerprints([other, t, text])[1:2]
    assert fingerprint.fingerprints([b""]) == ["2::"]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def test_common_subsequence_lengths():
    rng = random.Random(4)
    pairs = [("".join(rng.choice("abcd") for _ in range(rng.randint(0, 64))), "".join(rng.choice("abcd") for _ in range(rng.randint(0, 64)))) for _ in range(200)]
    assert fingerprint._lcs([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [lcs(a, b) for a, b in pairs]


def test_edited_neighbours(odd_docs):
    rows = odd_docs.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    docs = sorted(((r.doc_id, r.text or "") for r in rows.collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprint.edited_neighbours(rows).collect()}
    assert len(got) == len(docs)
    for i, (key, text) in enumerate(docs):
        k, following = len(text) // 3, docs[(i + 1) % len(docs)][1]
        edited = text[:len(text) - k] + following[:k]
        r = got[key]
        assert (r.n_chars, r.edited) == (len(text), edited)
        own, changed, nxt = fingerprint.fingerprints([x.encode() for x in (text, edited, following)])
        assert (r.fingerprint, r.edited_fingerprint) == (own, changed)
        assert (r.near_edited, r.near_next) == (fingerprint.likeness([own], [changed])[0], fingerprint.likeness([own], [nxt])[0])


def test_edited_neighbours_with_null_and_repeated_ids(odd_docs):
    assert fingerprint.edited_neighbours(odd_docs).count() == odd_docs.count()
    one = fingerprint.edited_neighbours(odd_docs.where("doc_id = 6")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


@pytest.mark.parametrize("kind", ["string", "decimal(12,1)", "date"])
def test_edited_neighbours_with_ids_of_other_types(spark, kind):
    key = {"string": F.concat(F.lit("d"), F.col("id").cast("string")), "decimal(12,1)": F.col("id") - F.lit(20.5), "date": F.date_add(F.lit("2024-01-01"), F.col("id").cast("int"))}[kind]
    rows = spark.range(60).select(key.cast(kind).alias("name"), F.concat(F.lit("text of "), F.repeat(F.col("id").cast("string"), 30)).alias("body"))
    rows = rows.unionByName(spark.createDataFrame([(None, "without a name")], "name string, body string").select(F.col("name").cast(kind), "body"))
    docs = sorted(((r.name, r.body) for r in rows.collect()), key=lambda x: (x[0] is not None, x[0] if x[0] is not None and kind != "string" else str(x[0])), reverse=True)
    got = {r.name: r.edited for r in fingerprint.edited_neighbours(rows, "name", "body").collect()}
    assert len(got) == len(docs)
    for i, (name, body) in enumerate(docs):
        k = len(body) // 3
        assert got[name] == body[:len(body) - k] + docs[(i + 1) % len(docs)][1][:k]


def test_fingerprints_in_parts(monkeypatch):
    rng = random.Random(5)
    texts = [rng.randbytes(rng.choice([0, 10, 300, 5000])) for _ in range(40)]
    whole = fingerprint.fingerprints(texts)
    monkeypatch.setattr(fingerprint, "AT_ONCE", 1000)
    assert fingerprint.fingerprints(texts) == whole and fingerprint.fingerprints([]) == []


def test_fingerprint_columns(odd_docs):
    rows = fingerprint.add_likeness(fingerprint.add_fingerprint(odd_docs), "fingerprint", "fingerprint").collect()
    assert all(r.likeness == 1.0 for r in rows)


def test_empty_tables(odd_docs):
    none = odd_docs.where("false")
    automaton = token_counts.Automaton([b"a"], [b"a"])
    for df in (bpe.encode(none, PATH), pii.find_pii(none), pii.redact(none), quality.quality(none), fingerprint.edited_neighbours(none),
               fingerprint.add_fingerprint(none), token_counts.count_tokens(none, automaton)):
        assert df.count() == 0
