"""BPE encoding and decoding (2) by batched numpy merge rounds.

The symbols of many words lie in one flat array. A round looks up the merge rank of every adjacent pair by binary
search in the sorted pair keys, takes the lowest rank of each word, merges its occurrences from left to right,
and looks up again only the pairs beside a merge. Words without a mergeable pair leave the array.

A vocabulary is one in the JSON format of the public tokenizers: byte-level symbols, ``</w>`` on a word's last symbol.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers


_NONE = np.iinfo(np.int64).max
#: Words merged in one flat array; bounds memory, not results.
GROUP = 4096


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = [b for b in range(256) if b not in set(plain)]
    chars = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
    return [chars[b] for b in range(256)]


class BpeTable:
    """Arrays of one vocabulary: bounded by its size, so it is broadcast to the tasks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pieces = {i: p for p, i in vocab.items()} | {i: p for p, i in self.special.items()}
        self.pieces = [pieces.get(i, "") for i in range(max(pieces) + 1)]
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + end] for c in chars], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        first: dict[int, tuple[int, int]] = {}
        made_at: dict[int, int] = {}
        self.stable = True
        for rank, (a, b) in enumerate(merges):
            key, to = vocab[a] << 32 | vocab[b], vocab[a + b]
            first[key] = (rank, to)
            made_at[to] = max(rank, made_at.get(to, -1))
        for key, (rank, _) in first.items():
            # A merge ranks after all merges that make its parts: then a round may merge all occurrences at once.
            self.stable &= made_at.get(key >> 32, -1) < rank and made_at.get(key & 0xFFFFFFFF, -1) < rank
        self.keys = np.array(sorted(first), np.int64)
        self.ranks = np.array([first[k][0] for k in self.keys.tolist()], np.int64)
        by_rank = {rank: to for rank, to in first.values()}
        self.made = np.zeros(len(merges) + 1, np.int64)
        for rank, to in by_rank.items():
            self.made[rank] = to

    @classmethod
    def of(cls, state: dict) -> BpeTable:
        """From ``vars(table)``: a broadcast holds plain values, so tasks need no import to read it."""
        table = cls.__new__(cls)
        table.__dict__.update(state)
        return table

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, or the largest integer."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE) if len(self.keys) else np.full(len(key), _NONE)


def merge_words(words: list[bytes], table: BpeTable) -> list[np.ndarray]:
    """The ids of each (non-empty) word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum(sizes)
    symbols = table.inner[flat]
    symbols[ends - 1] = table.last[flat[ends - 1]]
    word = np.repeat(np.arange(len(words)), sizes)
    out: list = [None] * len(words)
    # rank[i]: of the pair (i, i + 1); none across words
    rank = np.full(len(symbols), _NONE)
    inside = np.flatnonzero(word[:-1] == word[1:])
    rank[inside] = table.rank(symbols[inside], symbols[inside + 1])
    while len(symbols):
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        lowest = np.minimum.reduceat(rank, starts)
        stop = np.r_[starts[1:], len(symbols)]
        done = lowest == _NONE
        if done.any():
            for s, e in zip(starts[done].tolist(), stop[done].tolist(), strict=True):
                out[word[s]] = symbols[s:e]
            live = np.repeat(~done, stop - starts)
            symbols, word, rank = symbols[live], word[live], rank[live]
            if not len(symbols):
                break
            starts, lowest = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]), lowest[~done]
            stop = np.r_[starts[1:], len(symbols)]
        hit = np.flatnonzero(rank == np.repeat(lowest, stop - starts))
        if table.stable:
            # In a run of adjacent hits (as in "aaaa") every other one merges, from the left.
            run = np.r_[True, np.diff(hit) != 1]
            since = np.arange(len(hit)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            hit = hit[since % 2 == 0]
        else:
            hit = hit[np.r_[True, word[hit][1:] != word[hit][:-1]]]
        symbols = symbols.copy()
        symbols[hit] = table.made[rank[hit]]
        keep = np.ones(len(symbols), bool)
        keep[hit + 1] = False
        at = hit - np.searchsorted(hit, hit)  # places of the merged symbols once their right parts are gone
        symbols, word = symbols[keep], word[keep]
        rank[hit] = _NONE
        rank = rank[keep]
        near = np.unique(np.r_[at, at[at > 0] - 1])
        rank[near] = _NONE
        near = near[near < len(symbols) - 1]
        near = near[word[near] == word[near + 1]]
        rank[near] = table.rank(symbols[near], symbols[near + 1])
    return out


class Coder:
    """Encodes and decodes inside a task. Chunks between ASCII white space are remembered, within a bound."""

    def __init__(self, table: BpeTable):
        self.table = table
        self.words = regex.compile(table.pattern)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(table.special, key=len, reverse=True))) + ")") if table.special else None
        self.newer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.splits = pre_tokenizers.Split(Regex(table.pattern), "removed", invert=True)
        self.known: dict[bytes, bytes] = {}
        self.pieces = np.array(table.pieces, object)

    def pre_tokens(self, chunk: str) -> list[bytes]:
        """Normalise (NFC, lower case character by character) and split.

        Beyond the alphabets that no longer change, the tokenizers library tells what a letter is: its Unicode
        tables are newer than Python's.
        """
        if chunk and max(chunk) >= "\u0530":
            chunk = self.newer.normalize_str(chunk)
            return [w.encode("utf-8", "surrogatepass") for w, _ in self.splits.pre_tokenize_str(chunk)]
        chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        return [w.encode("utf-8", "surrogatepass") for w in self.words.findall(chunk)]

    def learn(self, chunks: set[bytes]) -> None:
        """Encode the chunks not yet known, their words together."""
        new = [c for c in chunks if c not in self.known]
        if len(self.known) + len(new) > 400_000:
            self.known.clear()
            new = list(chunks)
        cut = [(c, self.pre_tokens(c.decode("utf-8", "surrogatepass"))) for c in new]
        words = sorted({w for _, ws in cut for w in ws})
        ids: dict[bytes, bytes] = {}
        for at in range(0, len(words), GROUP):
            part = words[at: at + GROUP]
            ids |= {w: x.astype("<u4").tobytes() for w, x in zip(part, merge_words(part, self.table), strict=True)}
        for c, ws in cut:
            self.known[c] = b"".join([ids[w] for w in ws])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null has none."""
        cut: list[list] = []
        for t in texts:
            t = t or ""
            parts = self.special.split(t) if self.special and any(s in t for s in self.table.special) else [t]
            cut.append([p if i % 2 else p.encode("utf-8", "surrogatepass").split() for i, p in enumerate(parts)])
        self.learn({c for parts in cut for p in parts if isinstance(p, list) for c in p})
        known, special = self.known, self.table.special
        return [b"".join([b"".join(map(known.__getitem__, p)) if isinstance(p, list) else special[p].to_bytes(4, "little") for p in parts]) for parts in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The pieces of the ids joined by spaces, special tokens included; an id beyond the vocabulary has no piece."""
        return " ".join(self.pieces[ids[ids < len(self.pieces)]].tolist())

    def text_of(self, ids: np.ndarray, suffix: str = "</w>") -> str:
        """Readable text: bytes restored, words set apart by a space."""
        back = {c: b for b, c in enumerate(byte_chars())}
        out = bytearray()
        for i in ids.tolist():
            piece = self.table.pieces[i]
            if piece in self.table.special:
                out += piece.encode() + b" "
                continue
            word_end = piece.endswith(suffix)
            out += bytes(back[c] for c in (piece[: -len(suffix)] if word_end else piece)) + b" " * word_end
        return out.decode("utf-8", "replace")


def _struct(kinds: dict[str, pa.DataType], rows: list[tuple]) -> pa.Array:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True)], names=list(kinds))


def encode(docs: DataFrame, path: str, text: str = "text", ids: bool = True, decoded: bool = False, digests: bool = False) -> DataFrame:
    """Add the struct ``bpe`` to every row: n_tokens and, as asked, ids, decoded, and the two digests of the contract.

    Ids are those of the vocabulary at ``path`` without added special tokens; the strings of special tokens in a text become
    those tokens. Null and empty texts have no ids and decode to the empty text. Repeated rows are encoded alike,
    an empty table gives an empty table, other columns pass through (one named ``bpe`` is replaced).
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(BpeTable(path)))
    kinds = {"n_tokens": pa.int64()}
    kinds |= {"ids": pa.list_(pa.int32())} if ids else {}
    kinds |= {"decoded": pa.string()} if decoded else {}
    kinds |= {"ids_sha256": pa.string(), "decoded_sha256": pa.string()} if digests else {}
    names = {pa.int64(): "long", pa.string(): "string", pa.list_(pa.int32()): "array<int>"}

    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = Coder(BpeTable.of(shared.value))
        for texts in batches:
            parts = []
            for at in range(0, len(texts), 256):
                rows = []
                for raw in coder.encode(texts.slice(at, 256).to_pylist()):
                    row: list = [len(raw) // 4]
                    x = np.frombuffer(raw, "<u4")
                    text_back = coder.decode(x) if decoded or digests else None
                    row += [x.astype(np.int32)] * ids + [text_back] * decoded
                    if digests:
                        row += [hashlib.sha256(raw).hexdigest(), hashlib.sha256(text_back.encode()).hexdigest()]
                    rows.append(tuple(row))
                parts.append(_struct(kinds, rows))
            whole = pa.concat_arrays(parts) if parts else _struct(kinds, [])
            del parts
            pa.default_memory_pool().release_unused()
            yield whole

    kind = ", ".join(f"{k} {names[t]}" for k, t in kinds.items())
    return docs.withColumn("bpe", F.arrow_udf(coded, kind)(F.col(text)))


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the library's decoding of the array ``ids``; a null array gives the empty text."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(BpeTable(path)))

    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = Coder(BpeTable.of(shared.value))
        for x in batches:
            yield pa.array([coder.decode(np.array(i or [], np.int64)) for i in x.to_pylist()], pa.string())

    return docs.withColumn(out, F.arrow_udf(texts, "string")(F.col(ids)))

