"""What a worker of op13 remembers of its words: kept from task to task, bounded, and without effect on results."""

from __future__ import annotations

import random

import public_tokenizers
import pytest

from pairloom.llm import alignment


@pytest.fixture()
def files():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as a, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        return a.read(), b.read()


def _texts(n):
    rng = random.Random(n)
    odd = ["½ cup", "a  b", "…", "x\n\ny", "mark ▁ here", "日本語", "naïve", "end ", "\U0001f389!", "don't", "3.14"]
    return ["", *(" " + " ".join(rng.choice([*odd, "the", "of", f"w{rng.randrange(400)}"]) for _ in range(rng.randrange(1, 30))) for _ in range(n))]


def _whole_text(coder, text):
    """The alignment of a text that is encoded in one call."""
    if not text:
        return alignment.finish(alignment.EMPTY)
    a, b = coder.ids(text)
    raw = text.encode()
    ok = all(b"".join(table[i] for i in ids) == raw for table, ids in ((coder.a_bytes, a), (coder.b_bytes, b)))
    ends = (coder.a_size[a].cumsum(), coder.b_size[b].cumsum())
    return alignment.finish(alignment.fragment(a, b, *ends, coder.names, ok))


def test_a_worker_keeps_its_coder_and_words(files, monkeypatch):
    coder = alignment.worker_coder(*files)
    list(coder.fragments([" remembered words of one task"]))
    again = alignment.worker_coder(*files)
    assert again is coder
    monkeypatch.setattr(coder, "ids", lambda text: pytest.fail(f"encoded again: {text!r}"))
    assert [x.n_a > 0 for x in again.fragments([" of remembered words"])] == [True]


def test_frequent_words_stay_remembered_and_memory_is_bounded(files, monkeypatch):
    monkeypatch.setattr(alignment, "WORDS", 40)
    coder, asked = alignment.Coder(*files), []
    ids = coder.ids
    monkeypatch.setattr(coder, "ids", lambda text: asked.append(text) or ids(text))
    for i in range(60):
        list(coder.fragments([f" frequent rare{'abcdefgh'[i % 8]}{i}x other{i}"]))
        assert len(coder.known) + len(coder.older) <= 40 + 2 * 3
    assert sum("frequent" in text for text in asked) == 1


@pytest.mark.parametrize(("words", "chars"), [(150_000, 1_500_000), (20, 1_500_000), (150_000, 60)])
def test_forgotten_words_do_not_change_results(files, monkeypatch, words, chars):
    monkeypatch.setattr(alignment, "WORDS", words)
    monkeypatch.setattr(alignment, "CHARS", chars)
    coder, texts = alignment.Coder(*files), _texts(300)
    found = [x for at in range(0, len(texts), 7) for x in coder.fragments(texts[at: at + 7])]
    assert len(found) == len(texts)
    for text, x in zip(texts, found, strict=True):
        got, want = alignment.finish(x), _whole_text(coder, text)
        assert got[:4] == want[:4], repr(text)
        assert all((p == q).all() for p, q in zip(got[4:], want[4:], strict=True)), repr(text)
