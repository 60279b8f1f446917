"""Quality rules (9): word and line statistics, and lines that recur across the documents of a host.

A line is boilerplate when it stands in many distinct documents of one host, however often it recurs in each.
Copies of one document must not count as many documents, or every group of copies would be stripped bare before
de-duplication sees it. So documents are told apart by a digest of their whole text, and exact copies count once.
A document that the removal leaves with too few words is rejected.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, SPACES, hash64, slices, stored, words_of

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: A line is boilerplate in a host beyond this many documents, whatever the host's size.
MAX_LINE_DOCS = 20
SYMBOLS = "#*$%&|<>"
#: Bytes of boilerplate line keys that every worker may hold; more are joined to the lines of the documents.
BROADCAST_BYTES = 32 << 20
#: Bytes of a key in a set.
KEY_BYTES = 64
#: Places where a hot line meets its key in that join.
SALTS = 16

_DIGITS = re.compile(r"[0-9]+")
_signed = lambda x: x - (1 << 64) if x >> 63 else x


def line_key(line: str) -> int | None:
    """Hash of the normalised line: words joined by one space, lower case, runs of digits as 0; None without words."""
    words = words_of(line)
    if not words:
        return None
    return _signed(hash64(_DIGITS.sub("0", b" ".join(words).decode("utf-8", "replace").lower()).encode()))


def line_keys(text: str | None) -> set[int]:
    """The keys of the lines that have words, each once."""
    return {k for k in map(line_key, (text or "").split("\n")) if k is not None}


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text (null: all 0)."""
    text = text or ""
    words = words_of(text)
    with_words = [x for x in text.split("\n") if words_of(x)]
    repeat = 0
    grams = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    seen = Counter(grams)
    if len(seen) < len(grams):
        until = 0  # words before this one are counted
        for i, g in enumerate(grams):
            if seen[g] > 1:
                repeat += i + WINDOW - max(i, until)
                until = i + WINDOW
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
            len(with_words) - len(set(with_words)), repeat)


def document_lines(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """Host, line key and hash of the text, once for each distinct line of a row."""

    def emit(batches):
        for batch in batches:
            for part in slices(batch):
                out: list[tuple] = []
                for h, t, d in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    out += [(h, k, d) for k in line_keys(t)]
                hosts, keys, docs_of = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(docs_of, pa.int64())],
                                                 names=["_llm_host", "_llm_key", "_llm_doc"])

    return (docs.select(F.col(host).cast("string").alias("_llm_host"), F.col(text).alias("_llm_text"), F.xxhash64(text).alias("_llm_doc"))
            .mapInArrow(emit, "_llm_host string, _llm_key long, _llm_doc long"))


def frequent_lines(docs: DataFrame, text: str = "text", host: str = "source", max_docs: int = MAX_LINE_DOCS) -> DataFrame:
    """The boilerplate lines: host (null is a host) and line key, one row each."""
    # Distinct documents first: a hot line spreads over its documents, then only counts meet.
    counts = document_lines(docs, text, host).distinct().groupBy("_llm_host", "_llm_key").agg(F.count(F.lit(1)).alias("_llm_docs"))
    return counts.where(F.col("_llm_docs") > max_docs).drop("_llm_docs")


def _lines_of_documents(docs: DataFrame, frequent: DataFrame, text: str, host: str) -> DataFrame:
    """``_llm_lines`` of each distinct text of a host that has boilerplate lines: their keys, at most its own lines.

    A hot line meets its key in ``SALTS`` places, as the hash of the text decides.
    """
    lines = document_lines(docs, text, host).distinct().withColumn("_llm_salt", F.pmod("_llm_doc", F.lit(SALTS)))
    keys = frequent.select(F.col("_llm_host").alias("_llm_of"), F.col("_llm_key").alias("_llm_line"),
                           F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_llm_place"))
    same = (F.col("_llm_host").eqNullSafe(F.col("_llm_of")) & (F.col("_llm_key") == F.col("_llm_line"))
            & (F.col("_llm_salt") == F.col("_llm_place")))
    return lines.join(keys, same).groupBy("_llm_host", "_llm_doc").agg(F.collect_list("_llm_key").alias("_llm_lines"))


def quality(docs: DataFrame, text: str = "text", host: str = "source", max_docs: int = MAX_LINE_DOCS, clean: bool = True) -> DataFrame:
    """Add the struct ``quality`` to every row.

    Fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_lines,
    n_left_words, kept and, if ``clean``, clean_text (the text without boilerplate lines; null stays null).
    Null and empty texts have zeros and fail. An empty table gives an empty table; repeated rows are
    judged alike; other columns pass through, but a column named ``quality`` is replaced.
    """
    docs = docs.drop("quality")
    frequent = stored(frequent_lines(docs, text, host, max_docs), "frequent-lines")
    shared = None
    if frequent.count() * KEY_BYTES <= BROADCAST_BYTES:
        by_host: dict[str | None, set[int]] = {}
        for h, k in zip(*(c.to_pylist() for c in frequent.select("_llm_host", "_llm_key").toArrow().columns), strict=True):
            by_host.setdefault(h, set()).add(k)
        shared = docs.sparkSession.sparkContext.broadcast(by_host)
        joined = docs.withColumn("_llm_lines", F.col(host).cast("string"))  # the host leads a task to its lines
    else:
        lists = _lines_of_documents(docs, frequent, text, host)
        same = F.col(host).cast("string").eqNullSafe(F.col("_llm_host")) & (F.xxhash64(text) == F.col("_llm_doc"))
        joined = docs.join(lists, same, "left").drop("_llm_host", "_llm_doc")
    kind = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
            "n_removed_lines long, n_left_words long, kept boolean" + ", clean_text string" * clean)

    def judge(text: str | None, lines) -> tuple:
        stats = text_stats(text)
        failed = stats[0] < MIN_WORDS or 100 * stats[4] > MAX_REPEAT_PERCENT * stats[0]
        left, removed = text, 0
        if text and lines:
            frequent = set(lines) if shared is None else lines
            rows = text.split("\n")
            rest = [x for x in rows if line_key(x) not in frequent]
            removed, left = len(rows) - len(rest), "\n".join(rest)
        n_left = len(words_of(left)) if removed else stats[0]
        return (*stats, failed, removed, n_left, not failed and n_left >= MIN_WORDS, *([left] * clean))

    names = [x.split()[0] for x in kind.split(", ")]
    types = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.int64(), pa.bool_()] + [pa.string()] * clean

    def part(rows: list[tuple]) -> pa.Array:
        cols = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    @F.arrow_udf(kind)
    def judged(texts: pa.Array, lines: pa.Array) -> pa.Array:
        # Piece by piece, so that a batch of long texts is never held as Python objects.
        held = None if shared is None else shared.value
        out = [part([])]
        for at in range(0, len(texts), SLICE):
            pieces = zip(texts.slice(at, SLICE).to_pylist(), lines.slice(at, SLICE).to_pylist(), strict=True)
            out.append(part([judge(t, x if held is None else held.get(x)) for t, x in pieces]))
        whole = pa.concat_arrays(out)
        del out
        pa.default_memory_pool().release_unused()
        return whole

    return joined.withColumn("quality", judged(F.col(text), F.col("_llm_lines"))).drop("_llm_lines")
