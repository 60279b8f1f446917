"""Cross-tokenizer alignment (13): tokens of two tokenizers grouped by the byte offsets where both end.

A byte-range chunk of a text yields a fragment: an open prefix (tokens up to the first common end), closed groups, and
an open suffix (tokens behind the last common end). Joining neighbours is associative: an open suffix and the next
open prefix close one group. So very long texts are cut into chunks that Spark deals out, and their
fragments are joined ``FAN_IN`` at a time, level by level. Pairs of tokens that end together are counted over the
whole corpus.

Chunks are cut, and words remembered, where both tokenizers start anew: before a single space or line end
between characters that are no white space. Both end there together, so a word's groups are written once, and a
text has the groups of its words.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_chars
from .common import join_counted, stored
from .substrings import text_keys

CHUNK_BYTES = 64 << 10
FAN_IN = 16
#: Remembered words of one worker and their characters, and words encoded in one call.
WORDS, CHARS, CALL = 150_000, 1_500_000, 2_000
#: Bytes of pair counts that every worker may hold (24 a pair); more are joined.
BROADCAST_BYTES = 32 << 20
#: Texts handled at once.
ROWS = 64

#: White space, controls and invisible characters: a cut has none of them beside its space or line end.
_BLANK = r"\s\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff"
_WORD = re.compile(r"[ \n][^ \n]*")
_UNSAFE = re.compile(f"[{_BLANK}](?:[{_BLANK}]|$)")
_SAFE_CUT = re.compile(rf"(?<=[^{_BLANK}])(?=[ \n][^{_BLANK}])")
_SPACE_MARK = "\u2581"


def words_of(text: str) -> list[str]:
    """``text`` (which starts with a space) cut at all safe places."""
    return _SAFE_CUT.split(text) if _UNSAFE.search(text) else _WORD.findall(text)


def _plain(text: str) -> bool:
    """Whether words may be encoded together: one with other bytes sends all of them to be encoded one by one, hence none that NFKC changes."""
    return not _UNSAFE.search(text) and _SPACE_MARK not in text and unicodedata.is_normalized("NFKC", text)


def chunks_of(text: str, size: int) -> list[str]:
    """Space + ``text`` cut into pieces of about ``size`` UTF-8 bytes at safe places; longer where there is none."""
    whole = " " + text
    out, at, step = [], 0, max(1, size // 4)
    while at < len(whole):
        to = at + step
        # characters have one to four bytes: go on until the piece is large enough
        while to < len(whole) and len(whole[at:to].encode("utf-8", "surrogatepass")) < size:
            to += step
        found = _SAFE_CUT.search(whole, to) if to < len(whole) else None
        to = found.start() if found else len(whole)
        out.append(whole[at:to])
        at = to
    return out


class Fragment(NamedTuple):
    """What a chunk knows of its groups. Ids are packed 32-bit integers."""

    ok: bool  #: both tokenizers gave the chunk's bytes
    n_a: int
    n_b: int
    cut: bool  #: both tokenizers end together somewhere in the chunk; if not, all tokens are the prefix
    a0: bytes
    b0: bytes
    closed: str
    n_closed: int
    a1: bytes
    b1: bytes
    pairs: np.ndarray  #: ids of A * 2**32 + ids of B that end together, sorted
    counts: np.ndarray


EMPTY = Fragment(True, 0, 0, False, b"", b"", "", 0, b"", b"", np.zeros(0, np.int64), np.zeros(0, np.int64))


def _group(a: bytes, b: bytes) -> str:
    return "|".join(",".join(map(str, np.frombuffer(x, "<u4").tolist())) for x in (a, b))


def join(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring chunks. Associative; ``EMPTY`` is neutral."""
    a0, b0, a1, b1, closed, n = x.a0, x.b0, y.a1, y.b1, x.closed, x.n_closed
    if not x.cut:
        a0, b0, closed, n = a0 + y.a0, b0 + y.b0, y.closed, y.n_closed
    elif not y.cut:
        a1, b1 = x.a1 + y.a0, x.b1 + y.b0
    else:
        closed = ";".join(filter(None, (closed, _group(x.a1 + y.a0, x.b1 + y.b0), y.closed)))
        n += 1 + y.n_closed
    pairs, place = np.unique(np.r_[x.pairs, y.pairs], return_inverse=True)
    counts = np.zeros(len(pairs), np.int64)
    np.add.at(counts, place, np.r_[x.counts, y.counts])
    return Fragment(x.ok and y.ok, x.n_a + y.n_a, x.n_b + y.n_b, x.cut or y.cut, a0, b0, closed, n, a1, b1, pairs, counts)


class Names:
    """The ids of a tokenizer as text, with the mark that follows a token inside its group, at its end, or at a word's end."""

    def __init__(self, n: int, *marks: str):
        self.n, self.table = n, np.array([f"{i}{mark}" for mark in marks for i in range(n)], object)

    def of(self, ids: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return self.table[ids + self.n * mark]


def _grouped(common: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token, and whether the token closes it."""
    of = np.searchsorted(common, end)
    return of, (np.diff(of, append=-1) != 0) & (of < len(common))


def _written(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, mark_a: np.ndarray, mark_b: np.ndarray, names: tuple[Names, Names]) -> str:
    """Whole groups as text; the place of each token is its own number and the tokens of the other side before it."""
    text = np.empty(len(a) + len(b), object)
    text[np.arange(len(a)) + np.searchsorted(of_b, of_a)] = names[0].of(a, mark_a)
    text[np.arange(len(b)) + np.searchsorted(of_a, of_b, "right")] = names[1].of(b, mark_b)
    return "".join(text.tolist())


def fragment(a: np.ndarray, b: np.ndarray, a_end: np.ndarray, b_end: np.ndarray, names: tuple[Names, Names], ok: bool = True) -> Fragment:
    """From the ids of the tokens that end in a chunk, and their end offsets."""
    common = np.intersect1d(a_end, b_end, assume_unique=True)
    if not len(common):
        return EMPTY._replace(ok=ok, n_a=len(a), n_b=len(b), a0=a.tobytes(), b0=b.tobytes())
    (of_a, last_a), (of_b, last_b) = _grouped(common, a_end), _grouped(common, b_end)
    (i0, i1), (j0, j1) = (np.searchsorted(g, [1, len(common)]) for g in (of_a, of_b))
    closed = _written(a[i0:i1], b[j0:j1], of_a[i0:i1], of_b[j0:j1], last_a[i0:i1], last_b[j0:j1], names)[:-1]
    pairs, counts = np.unique(a[last_a].astype(np.int64) << 32 | b[last_b], return_counts=True)
    return Fragment(ok, len(a), len(b), True, a[:i0].tobytes(), b[:j0].tobytes(), closed, len(common) - 1,
                    a[i1:].tobytes(), b[j1:].tobytes(), pairs, counts)


def finish(x: Fragment) -> tuple:
    """(n_a, n_b, n_groups, groups, pairs, counts) of a whole text; one with an open end or other bytes has no tokens."""
    if not (x.ok and x.cut) or x.a1 or x.b1:
        return 0, 0, 0, "", EMPTY.pairs, EMPTY.counts
    return x.n_a, x.n_b, x.n_closed + 1, ";".join(filter(None, (_group(x.a0, x.b0), x.closed))), x.pairs, x.counts


#: What is remembered of a word of which a tokenizer gives other bytes.
CHANGED = "", b"", 0


class Coder:
    """Both tokenizers inside a task: A in the JSON format of the tokenizers library (byte level), B of sentencepiece."""

    def __init__(self, a_json: str, b_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        back = {c: i for i, c in enumerate(byte_chars())}
        pieces = {i: bytes(back[c] for c in p) if all(c in back for c in p) else p.encode() for p, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        kinds = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE_MARK, " ").encode() for i, p in enumerate(kinds)]
        # Words may be encoded apart if no piece goes on over a space or line end.
        self.apart = not any(re.search(f"[^{_SPACE_MARK}]{_SPACE_MARK}", p) or "\n" in p for p in kinds)
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.names = Names(len(self.a_bytes), ",", "|"), Names(len(self.b_bytes), ",", ";", ";\n")
        #: Of the words that are remembered: groups with a last ";", packed pairs, ids of A * 2**32 + ids of B; or ``CHANGED``.
        self.known: dict[str, tuple[str, bytes, int]] = {}
        self.older: dict[str, tuple[str, bytes, int]] = {}
        self.chars = 0  # of the words in ``known``

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Of a text that starts with a space or a line end."""
        a = self.a.encode(text, add_special_tokens=False).ids
        # B puts a space before what it is given; before a line end that space is a token of its own.
        b = self.b.encode(text[1:]) if text[0] == " " else self.b.encode(text)[1:]
        return np.array(a, "<u4"), np.array(b, "<u4")

    def _gives(self, raw: bytes, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether both tokenizers gave the bytes of the text."""
        return all(b"".join(map(table.__getitem__, ids.tolist())) == raw for table, ids in ((self.a_bytes, a), (self.b_bytes, b)))

    def _one(self, word: str) -> None:
        a, b = self.ids(word)
        if not self._gives(word.encode("utf-8", "surrogatepass"), a, b):
            self.known[word] = CHANGED
            return
        n_a, n_b, _, groups, pairs, counts = finish(fragment(a, b, np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]), self.names))
        self.known[word] = f"{groups};", np.repeat(pairs, counts).tobytes(), n_a << 32 | n_b

    def _many(self, words: list[str]) -> bool:
        """Encode the words as one text, and cut its groups at the words' ends; False where that fails."""
        a, b = self.ids(whole := " a" + "".join(words))
        raw = whole.encode("utf-8", "surrogatepass")
        if not self._gives(raw, a, b):
            return False
        ends = np.cumsum([2, *(len(w) for w in words)] if len(raw) == len(whole) else [2, *(len(w.encode("utf-8", "surrogatepass")) for w in words)])
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        common = np.intersect1d(a_end, b_end, assume_unique=True)
        last = np.searchsorted(common, ends)  # the last group of each word
        if (common[last] != ends).any():
            return False
        (of_a, last_a), (of_b, last_b) = _grouped(common, a_end), _grouped(common, b_end)
        mark = np.ones(len(common), np.int64)
        mark[last] = 2
        groups = _written(a, b, of_a, of_b, last_a, np.where(last_b, mark[of_b], 0), self.names).split("\n")[1:-1]
        pairs = (a[last_a].astype(np.int64) << 32 | b[last_b]).tobytes()
        cut = (8 * (last + 1)).tolist()
        n_a, n_b = (np.diff(np.searchsorted(of, last, "right")) for of in (of_a, of_b))
        self.known.update(zip(words, zip(groups, [pairs[i:j] for i, j in zip(cut, cut[1:])], (n_a << 32 | n_b).tolist(), strict=True), strict=True))
        return True

    def learn(self, words: set[str]) -> None:
        if len(self.known) > WORDS // 2 or self.chars > CHARS // 2:  # bounds memory; a word not met for so long is forgotten, and encoded again
            self.older, self.known, self.chars = self.known if self.chars <= CHARS else {}, {}, 0
        new = words.difference(self.known)
        self.chars += sum(map(len, new))
        self.known.update((w, self.older[w]) for w in new if w in self.older)
        new = list(new.difference(self.older))
        for at in range(0, len(new), CALL):
            part = new[at: at + CALL]
            plain = part if _plain("".join(part)) else [w for w in part if _plain(w)]
            apart = set(part).difference(plain) if plain and self._many(plain) else part
            for w in apart:
                self._one(w)

    def fragments(self, chunks: list[str]) -> Iterator[Fragment]:
        """Of chunks that start with a space or line end."""
        cut = [(words_of(c) if self.apart else [c]) if c else [] for c in chunks]
        words = pa.array(list(chain.from_iterable(cut)), pa.string()).dictionary_encode()
        distinct, at = words.dictionary.to_numpy(False).tolist(), words.indices
        self.learn(set(distinct))
        found = [self.known[w] for w in distinct]
        # the words' groups and pairs one after another, and where each chunk's end
        ends = np.cumsum([0, *map(len, cut)])
        groups, pairs = (pa.array([x[i] for x in found], kind).take(at) for i, kind in ((0, pa.string()), (1, pa.binary())))
        group_ends, pair_ends = (np.frombuffer(x.buffers()[1], np.int32)[ends].tolist() if len(at) else [0] * len(ends) for x in (groups, pairs))
        written, packed = (x.buffers()[2] or pa.py_buffer(b"") for x in (groups, pairs))
        size = np.array([x[2] for x in found], np.int64)[at.to_numpy()]
        for i, n in enumerate(map(len, cut)):
            sizes = size[ends[i]: ends[i + 1]]
            if not n or not sizes.all():
                yield EMPTY._replace(ok=not n)
                continue
            first, _, closed = written[group_ends[i]: group_ends[i + 1] - 1].to_pybytes().decode().partition(";")
            a0, b0 = (np.array(list(map(int, x.split(","))), "<u4").tobytes() for x in first.split("|"))
            each = np.frombuffer(packed[pair_ends[i]: pair_ends[i + 1]], np.int64)
            yield Fragment(True, int((sizes >> 32).sum()), int((sizes & 0xFFFFFFFF).sum()), True, a0, b0, closed, len(each) - 1, b"", b"",
                           *np.unique(each, return_counts=True))


@lru_cache(1)
def worker_coder(a_json: str, b_model: bytes) -> Coder:
    """The coder of a Python worker, which keeps it and its words from task to task."""
    return Coder(a_json, b_model)


_LISTS = pa.list_(pa.int32())
_RESULT = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "groups_sha256": pa.string(), "pair_a": _LISTS, "pair_b": _LISTS, "pair_n": _LISTS}
_SQL = {pa.int64(): "long", pa.string(): "string", _LISTS: "array<int>", pa.bool_(): "boolean", pa.binary(): "binary", pa.int32(): "int",
        pa.list_(pa.int64()): "array<long>"}


def _results(rows: list[Fragment], groups: bool) -> pa.StructArray:
    """The alignments of whole texts, as one array."""
    done = [finish(x) for x in rows]
    kinds = _RESULT | ({"groups": pa.string()} if groups else {})
    offsets = pa.array(np.cumsum([0, *(len(x[4]) for x in done)]), pa.int32())
    pairs, counts = (np.concatenate([np.zeros(0, np.int64), *(x[i] for x in done)]) for i in (4, 5))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (pairs >> 32, pairs & 0xFFFFFFFF, counts)]
    sha = [hashlib.sha256(x[3].encode()).hexdigest() if x[2] else "" for x in done]
    cols = [pa.array([x[i] for x in done], pa.int64()) for i in range(3)] + [pa.array(sha, pa.string())] + lists
    return pa.StructArray.from_arrays(cols + [pa.array([x[3] for x in done], pa.string())] * groups, names=list(kinds))


_FRAGMENT = {"ok": pa.bool_(), "n_a": pa.int64(), "n_b": pa.int64(), "cut": pa.bool_(), "a0": pa.binary(), "b0": pa.binary(), "closed": pa.string(),
             "n_closed": pa.int64(), "a1": pa.binary(), "b1": pa.binary(), "pairs": pa.list_(pa.int64()), "counts": pa.list_(pa.int64())}


def _fragment_columns(rows: list[Fragment]) -> list[pa.Array]:
    return [pa.array([getattr(x, k) for x in rows], t) for k, t in _FRAGMENT.items()]


def _fragments_of(batch) -> list[Fragment]:
    cols = [batch.column(k).to_pylist() for k in _FRAGMENT]
    return [Fragment(*row[:-2], np.array(row[-2], np.int64), np.array(row[-1], np.int64)) for row in zip(*cols, strict=True)]


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", chunk_bytes: int = CHUNK_BYTES, groups: bool = False) -> DataFrame:
    """Add the struct ``alignment`` to every row: n_a, n_b, n_groups, groups_sha256, pair_a, pair_b, pair_n and, if ``groups``, groups.

    Tokenizer A (``a_path``: JSON of the tokenizers library, byte-level) encodes space + text, B (``b_path``: sentencepiece, which puts the
    space itself) the text, both without special tokens. ``groups`` is ``a1,a2|b1;a3|b2,b3``: ids in order. The pairs are the
    distinct (A, B) ids that end together and how often. Texts that are null, empty or change in a tokenizer have no
    tokens: zeros, empty strings and lists. Longer texts than ``chunk_bytes`` are cut into chunks and their fragments
    joined; each distinct one once. Repeated rows get equal results, an empty table gives an empty table,
    other columns pass through (one named ``alignment`` is replaced).
    """
    docs = docs.drop("alignment")
    with open(a_path, encoding="utf-8") as f:
        spec = json.load(f)
    with open(b_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast((json.dumps(spec), f.read()))
    kinds = _RESULT | ({"groups": pa.string()} if groups else {})
    kind = ", ".join(f"{k} {_SQL[t]}" for k, t in kinds.items())

    def whole(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = worker_coder(*shared.value)
        for texts in batches:
            out = [_results([], groups)]
            for at in range(0, len(texts), ROWS):
                chunks = [" " + t if t else "" for t in texts.slice(at, ROWS).to_pylist()]
                out.append(_results(list(coder.fragments(chunks)), groups))
            yield pa.concat_arrays(out)

    short = F.coalesce(F.octet_length(text), F.lit(0)) <= chunk_bytes
    done = docs.where(short).withColumn("alignment", F.arrow_udf(whole, kind)(F.col(text)))

    keyed = docs.where(~short).select("*", *text_keys(F.col(text)))
    key = ["_llm_t1", "_llm_t2"]
    key_sql = "_llm_t1 long, _llm_t2 long, no int"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                parts = chunks_of(one.column("t")[0].as_py(), chunk_bytes)
                same = pa.array([0] * len(parts))
                yield pa.RecordBatch.from_arrays([one.column(k).take(same) for k in key] + [pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())],
                                                 names=[*key, "no", "chunk"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_coder(*shared.value)
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                found = list(coder.fragments(one.column("chunk").to_pylist()))
                yield pa.RecordBatch.from_arrays([one.column(k) for k in [*key, "no"]] + _fragment_columns(found), names=[*key, "no", *_FRAGMENT])

    def combine(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("no").combine_chunks()
        total = reduce(join, _fragments_of(rows))
        first = rows.slice(0, 1)
        return pa.table([first.column(k) for k in key] + [pa.array([first.column("no")[0].as_py() // FAN_IN], pa.int32())] + _fragment_columns([total]), names=[*key, "no", *_FRAGMENT])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in key] + [_results(_fragments_of(batch), groups)], names=[*key, "alignment"])

    texts = keyed.groupBy(*key).agg(F.first(text).alias("t"), F.count(F.lit(1)).alias("rows"))
    texts = stored(texts, "long-texts")
    chunks = texts.mapInArrow(split, key_sql + ", chunk string").repartition(*key, "no")
    kind_of_fragment = key_sql + ", " + ", ".join(f"{k} {_SQL[t]}" for k, t in _FRAGMENT.items())
    parts = stored(chunks.mapInArrow(encode, kind_of_fragment), "fragments")
    n_parts = parts.agg(F.max("no")).first()[0] or 0
    while n_parts:
        parts = parts.groupBy(*key, F.expr(f"no div {FAN_IN}")).applyInArrow(combine, kind_of_fragment)
        n_parts //= FAN_IN
    struct = f"struct<{kind.replace(', ', ',').replace(' ', ':')}>"
    closed = stored(parts.drop("no").mapInArrow(close, f"_llm_t1 long, _llm_t2 long, alignment {struct}").join(texts.select(*key, "rows"), key), "long-alignments")
    n_long = closed.agg(F.sum("rows")).first()[0] or 0
    return done.unionByName(join_counted(keyed, closed, key, "rows", n_long, F.monotonically_increasing_id()).drop(*key))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, links, best) of the whole corpus: how many links hold the ids of A and B, and whether none of B's ids has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def summed():
            pairs, place = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            counts = np.zeros(len(pairs), np.int64)
            np.add.at(counts, place, np.concatenate([n for _, n in held]))
            return pairs, counts

        def out():
            pairs, counts = summed()
            return pa.RecordBatch.from_arrays([pa.array((pairs >> 32).astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), pa.array(counts)], names=["a", "b", "n"])

        for batch in batches:
            a, b, n = (batch.column(k).flatten().to_numpy().astype(np.int64) for k in ("pair_a", "pair_b", "pair_n"))
            held.append((a << 32 | b, n))
            size += len(a)
            if size > 1_000_000:
                held = [summed()]
                size = len(held[0][0])
                if size > 500_000:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    parts = aligned.select("alignment.pair_a", "alignment.pair_b", "alignment.pair_n").mapInArrow(run, "a int, b int, n long")
    counts = stored(parts.groupBy("a", "b").agg(F.sum("n").alias("links")), "pair-counts")  # at most the product of two vocabularies
    most = counts.groupBy("b").agg(F.max("links").alias("most"))
    return stored(counts.join(most, "b").select("a", "b", "links", (F.col("links") == F.col("most")).alias("best")), "pair-counts")


def score_links(aligned: DataFrame, counts: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Add n_links, n_best (links whose pair is its B id's most frequent, ties included) and count_sum to the rows of ``align``.

    ``counts`` is that of ``pair_counts``, or any other; a pair that it lacks counts 0.
    """
    if counts.count() * 24 <= broadcast_bytes:
        table = counts.orderBy("a", "b").toArrow()
        a, b, links, best = (table[c].to_numpy() for c in ("a", "b", "links", "best"))
        shared = aligned.sparkSession.sparkContext.broadcast((a.astype(np.int64) << 32 | b, links.astype(np.int64), best.astype(np.int64)))

        @F.arrow_udf("n_links long, n_best long, count_sum long")
        def score(a: pa.Array, b: pa.Array, n: pa.Array) -> pa.Array:
            codes, links, best = shared.value
            ends = a.offsets.to_numpy().astype(np.int64)
            ends = ends - ends[0]
            x, y, n = (v.flatten().to_numpy().astype(np.int64) for v in (a, b, n))
            if len(codes):
                x = x << 32 | y
                at = np.minimum(np.searchsorted(codes, x), len(codes) - 1)
                known = codes[at] == x
                links, best = np.where(known, links[at], 0), np.where(known, best[at], 0)
            else:
                links = best = np.zeros(len(x), np.int64)
            sums = [np.diff(np.r_[0, np.cumsum(v)][ends]) for v in (n, n * best, n * links)]
            return pa.StructArray.from_arrays([pa.array(v) for v in sums], names=["n_links", "n_best", "count_sum"])

        made = score("alignment.pair_a", "alignment.pair_b", "alignment.pair_n")
        return aligned.withColumn("_llm_s", made).select(*aligned.columns, "_llm_s.*")
    rows = stored(aligned.withColumn("_llm_row", F.monotonically_increasing_id()), "aligned")
    each = rows.select("_llm_row", F.explode(F.arrays_zip(*[F.col(f"alignment.pair_{x}").alias(x) for x in "abn"])).alias("p")).select("_llm_row", "p.*")
    held = each.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_rows"))
    keys = held.join(counts, ["a", "b"])
    met = join_counted(each, keys, ["a", "b"], "n_rows", each.count(), F.col("_llm_row"), "left")
    n, known = F.col("n").cast("long"), F.coalesce("links", F.lit(0)).cast("long")
    sums = met.groupBy("_llm_row").agg(F.sum(n).alias("n_links"), F.sum(F.when(F.col("best"), n).otherwise(0)).alias("n_best"), F.sum(n * known).alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_links", "n_best", "count_sum")]
    return rows.join(sums, "_llm_row", "left").select(*aligned.columns, *zero)
