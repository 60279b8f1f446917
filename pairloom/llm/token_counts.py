"""Token counts (4): greedy longest-match word pieces by a linear automaton, without building pieces.

The vocabulary's trie gets failure links: where a node has no edge for the next byte, its link leads to the node of what
is left after greedily popping pieces, and the number of pieces popped on the way is known beforehand. So every byte
is read once and the pieces of a word are counted, not made.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_chars
from .common import Memo, words_of


class Automaton:
    """``initial`` pieces begin a word, ``continuation`` pieces go on; both are bytes.

    With ``lone_mark`` the mark before a word is a piece itself: where no initial piece fits, it is one token and the
    whole word is cut into continuation pieces.
    """

    def __init__(self, initial: Iterable[bytes], continuation: Iterable[bytes], lone_mark: bool = False):
        self.edges: list[dict[int, int]] = [{}, {}]  # nodes 0 and 1: the roots of the two kinds
        ends = {self._add(0, p) for p in initial if p} | {self._add(1, p) for p in continuation if p}
        self.fail = [-1] * len(self.edges)
        self.pops = [0] * len(self.edges)
        if lone_mark:
            self.fail[0], self.pops[0] = 1, 1
        queue = deque([(0, -1, 0), (1, -1, 0)])
        while queue:
            node, parent, byte = queue.popleft()
            if parent >= 0:
                if node in ends:
                    self.fail[node], self.pops[node] = 1, 1
                else:
                    # What the parent pops, then as many links as it takes until the byte fits.
                    z, n = self.fail[parent], self.pops[parent]
                    while z >= 0 and byte not in self.edges[z]:
                        z, n = self.fail[z], n + self.pops[z]
                    if z >= 0:
                        self.fail[node], self.pops[node] = self.edges[z][byte], n
            queue.extend((to, node, b) for b, to in sorted(self.edges[node].items()))

    @classmethod
    def of(cls, state: dict) -> Automaton:
        """From ``vars(automaton)``: a broadcast holds plain values, so tasks need no import to read it."""
        automaton = cls.__new__(cls)
        automaton.__dict__.update(state)
        return automaton

    def _add(self, node: int, piece: bytes) -> int:
        for b in piece:
            if b not in self.edges[node]:
                self.edges[node][b] = len(self.edges)
                self.edges.append({})
            node = self.edges[node][b]
        return node

    def count(self, word: bytes) -> int:
        """Pieces of a word; a word that cannot be cut into pieces is one unknown token; the empty word has none."""
        edges, fail, pops = self.edges, self.fail, self.pops
        node, n = 0, 0
        for b in word:
            while b not in edges[node]:
                n += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = edges[node][b]
        while node > 1:
            n += pops[node]
            node = fail[node]
            if node < 0:
                return 1
        return n


def _vocabulary(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as f:
        return json.load(f)["model"]["vocab"]


def byte_level_pieces(path: str, space: str = "Ġ") -> tuple[list[bytes], list[bytes]]:
    """Pieces of a byte-level vocabulary file: those that start with the space mark begin words, all others go on.

    The mark alone holds no byte of a word and is in neither list; ``byte_level_automaton`` takes it in.
    """
    vocab = _vocabulary(path)
    back = {c: b for b, c in enumerate(byte_chars())}
    made = lambda p: bytes(back[c] for c in p)
    plain = [p for p in vocab if all(c in back for c in p)]
    return [made(p[1:]) for p in plain if p.startswith(space) and len(p) > 1], [made(p) for p in plain if not p.startswith(space)]


def byte_level_automaton(path: str, space: str = "Ġ") -> Automaton:
    """Automaton over the whole vocabulary of a byte-level file, the lone space mark included where the file has it."""
    return Automaton(*byte_level_pieces(path, space), lone_mark=space in _vocabulary(path))


def count_tokens(docs: DataFrame, automaton: Automaton, text: str = "text", out: str = "tokens") -> DataFrame:
    """Add the struct ``out`` (n_words, n_tokens) to every row.

    Words are what stands between ASCII white space. Null and empty texts have none; repeated rows count alike; an empty
    table gives an empty table; other columns pass through. The automaton's size is the vocabulary's.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(automaton))

    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Memo(Automaton.of(shared.value).count)
        for texts in batches:
            n_words, n_tokens = [], []
            for at in range(0, len(texts), 256):
                for t in texts.slice(at, 256).to_pylist():
                    words = words_of(t)
                    n_words.append(len(words))
                    n_tokens.append(sum(map(known.__getitem__, words)))
            yield pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["n_words", "n_tokens"])

    return docs.withColumn(out, F.arrow_udf(counted, "n_words long, n_tokens long")(F.col(text)))
