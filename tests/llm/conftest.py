from __future__ import annotations

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def shared(spark):
    """The test session; written tables go below its checkpoint folder."""
    return spark


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, one word, ties, repeats, odd characters, and a very long text."""
    rng = random.Random(5)
    vocabulary = ["tion", "the", "erin", "of", "heat", "sur", "éau", "über", "niño", "日本語", "Σίσυφος", "x" * 40]
    body = " ".join(rng.choice(vocabulary) + str(rng.randrange(60)) for _ in range(400))
    return [None, "", " \t\n", "One", "one", "Two words", body, body, body + " more", body.replace("of", "OF", 3),
            "\n".join(["same line here"] * 6), "a\x1cb\x85c\xa0d \x0be", "mail a@b.co, a@b.co.x_y@z.org 1.2.3.4.5.6.7.8 256.1.1.1",
            "card 4111 1111 1111 1111, +1 (219) 555-0563 and 4111-1111-1111-1112", body * 30, "!!! ... ???", "é É ퟿\U0001f389"]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """The texts with ids, repeated ids, a null id, null sources, and columns whose names results use as well."""
    rows = [(i, t, ["b", "a", None, "c"][i % 4], "en", i, {"k": i}, "w") for i, t in enumerate(odd_texts)]
    rows += [(3, "One", "c", "en", 3, {"k": 3}, "w"), (3, "One", "c", "en", 3, {"k": 3}, "w"), (None, "no id here", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, size int, quality map<string,int>, n_chars string")
