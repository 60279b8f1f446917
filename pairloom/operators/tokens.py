"""Corpus token jobs: tokens, vocabularies, pair counts, BPE, encode/decode, padding
(X5-X8, X10, J6).

Tokens stay an array in the row of their text, and ids are put in their place there: the table
(vocabulary or merges) goes to the tasks, so token occurrences are never shuffled and every
text keeps its row, also one without tokens. Only counting (vocabulary, pairs) shuffles, after
a map-side sum. Against a vocabulary beyond the checked size each block of rows asks once for each of its distinct tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T
from ..plans.indexing import row_index
from ..session import cut_lineage

#: Bytes of merge-table text that are shipped to the tasks; a larger one is no merge table.
MAX_MERGE_BYTES = 256 * 1024 * 1024
#: Vocabulary entries that are shipped to the tasks (16 bytes each), and bytes of their strings; beyond, blocks of rows ask for their entries.
MAX_ENTRIES, MAX_PIECE_BYTES = 2_000_000, 128 * 1024 * 1024
#: Rows of a block are at most 2 to this power, and hold about so many keys at most.
BLOCK_BITS, BLOCK_KEYS = 10, 1 << 19
#: Entries of one part of the key space, about (fewer where the session has more shuffle partitions), and entries packed at once.
PART_ENTRIES, PACKED_ENTRIES = 1 << 20, 1 << 19


def tokenize(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tokens): X1-X3 tokens of every text; blank and null texts have an empty array."""
    return docs.select(F.col(id_col), T.tokens(text_col).alias("tokens"))


def token_occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, token): one row per token, 0-based positions; for counting."""
    return tokenize(docs, id_col, text_col).select(F.col(id_col), F.posexplode("tokens").alias("pos", "token"))


def token_counts(rows: DataFrame) -> DataFrame:
    """(token, count) of occurrences (a ``token`` column) or of token arrays (``tokens``).

    Arrays are counted batch by batch in Arrow, so a task passes on its distinct tokens, not its occurrences.
    """
    if "tokens" not in rows.columns:
        return rows.groupBy("token").agg(F.count(F.lit(1)).alias("count"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = batch.column(0).flatten().value_counts()
            yield pa.RecordBatch.from_arrays([seen.field("values"), seen.field("counts")], names=["token", "n"])

    parts = rows.select("tokens").mapInArrow(_frugal(run), "token string, n long")
    return parts.groupBy("token").agg(F.sum("n").alias("count"))


def vocabulary(rows: DataFrame, n_special: int = 3) -> DataFrame:
    """(token, count, id): ids by (count desc, token), after ``n_special`` reserved ids; see ``token_counts`` for ``rows``."""
    counts = token_counts(rows)
    ranked = row_index(counts, [-F.col("count"), F.col("token")], name="_r", start=0)
    return ranked.select("token", "count", (F.col("_r") + n_special).cast("long").alias("id"))


def special_ids(n_pieces: int, n_reserved: int = 0) -> tuple[int, int]:
    """Start and end ids that follow a vocabulary of ``n_pieces`` ids after ``n_reserved`` reserved ones."""
    return n_reserved + n_pieces, n_reserved + n_pieces + 1


def _list_of(values: np.ndarray, lists: pa.ListArray) -> pa.ListArray:
    """``values`` in the shape of ``lists``."""
    offsets = lists.offsets.to_numpy()
    return pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(values))


def _frugal(run):
    """``run`` with memory handed back behind each batch; a worker otherwise keeps what its largest batch took, idle or not."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch
            del batch
            pa.default_memory_pool().release_unused()

    return step


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of the key space that each whole-number key lies in."""
    return ((keys.astype("<i8").view("<u8") * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(parts)).astype("<u2")


def _written(names: list[str], arrays: list[pa.Array]) -> bytes:
    """A batch as one binary value."""
    batch, to = pa.RecordBatch.from_arrays(arrays, names=names), pa.BufferOutputStream()
    with pa.ipc.new_stream(to, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return to.getvalue().to_pybytes()


def _read(value: pa.BinaryScalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(value.as_buffer()).read_next_batch()


def _numbers(value: pa.BinaryScalar) -> np.ndarray:
    return _read(value).column(0).to_numpy()


def _by_part(which: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part that occurs, with its places in their order."""
    order = np.argsort(which, kind="stable")
    starts = np.flatnonzero(np.diff(which[order], prepend=-1))
    for at, end in zip(starts, [*starts[1:], len(order)], strict=False):
        yield int(which[order[at]]), order[at:end]


def _one(columns: list[pa.ChunkedArray]) -> list[pa.Array]:
    return [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (c.combine_chunks() for c in columns)]


def _packed_rows(rows: int, parts: int):
    """Blocks of at most ``rows`` rows (_id, _keys): ids, sizes, the distinct keys with their parts, and each key's place among them in two halves.

    Places go by first occurrence, so the frequent keys have small ones and the upper half is mostly zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        n = keys = 0

        def packed() -> pa.RecordBatch:
            ids, lists = _one(pa.Table.from_batches(held).columns)
            coded = lists.flatten().dictionary_encode()
            places = pc.add(pc.fill_null(coded.indices, -1), 1).to_numpy(zero_copy_only=False).astype("<u4")  # 0: a null key
            sizes = np.diff(lists.offsets.to_numpy()).astype("<i4")
            distinct = coded.dictionary.to_numpy(zero_copy_only=False).astype("<i8")
            values = [sizes, distinct, _part_of(distinct, parts), (places & 0xFFFF).astype("<u2"), (places >> 16).astype("<u2")]
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *[pa.array([_written(["x"], [pa.array(x)])], pa.binary()) for x in (ids, *values)]],
                                              names=["_block", "_ids", "_sizes", "_keys", "_parts", "_low", "_high"])

        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                more = len(batch.column(1).flatten())
                if held and (n + batch.num_rows > rows or keys + more > BLOCK_KEYS):
                    yield packed()
                    block, held, n, keys = block + 1, [], 0, 0
                held.append(batch)
                n, keys = n + batch.num_rows, keys + more
        if held:
            yield packed()

    return run


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (_block, _keys, _parts) as what they ask of each part."""
    for batch in batches:
        for block, keys, which in zip(*batch.columns, strict=True):
            keys = _numbers(keys)
            asks = [(part, _written(["x"], [pa.array(keys[at])])) for part, at in _by_part(_numbers(which).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in asks], pa.int32()), pa.array([1] * len(asks), pa.int32()), pa.array([block.as_py()] * len(asks), pa.int64()), pa.array([k for _, k in asks], pa.binary())],
                names=["_part", "_side", "_block", "_what"])


def _packed_entries(parts: int):
    """Entries (key, value) part by part, those of many rows in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            keys, values = _one(pa.Table.from_batches(held).columns)
            found = [(part, _written(["key", "value"], [keys.take(at), values.take(at)]))
                     for part, at in ((p, pa.array(x)) for p, x in _by_part(_part_of(keys.to_numpy(), parts).astype(np.int64)))]
            n = len(found)
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([0] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.array([x for _, x in found], pa.binary())],
                                              names=["_part", "_side", "_block", "_what"])

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= PACKED_ENTRIES:
                yield packed()
                held = []
        if any(x.num_rows for x in held):
            yield packed()

    return run


def _answered(value: pa.DataType):
    """Answers (_block, _part, _what) to what blocks ask of the parts; a part's entries come before the blocks. Of a key's values the least counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, entries, table = None, [], None
        for batch in batches:
            blocks, which, answers = [], [], []
            for p, side, block, what in zip(*(batch[c] for c in ("_part", "_side", "_block", "_what")), strict=True):
                if p.as_py() != part:
                    part, entries, table = p.as_py(), [], None
                if side.as_py() == 0:
                    entries.append(_read(what))
                    continue
                if table is None:
                    table = pa.Table.from_batches(entries, pa.schema([("key", pa.int64()), ("value", value)]))
                    table, entries = table.take(pc.sort_indices(table, [("key", "ascending"), ("value", "ascending")])), []
                    (values,), known = _one([table["value"]]), table["key"].to_numpy()
                asked = _numbers(what)
                at = np.searchsorted(known, asked)
                held = np.minimum(at, max(len(known) - 1, 0))
                missing = known[held] != asked if len(known) else np.ones(len(asked), bool)
                blocks.append(block.as_py())
                which.append(part)
                answers.append(_written(["value"], [values.take(pa.array(held, mask=missing))]))
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(which, pa.int32()), pa.array(answers, pa.binary())], names=["_block", "_part", "_what"])

    return run


def _assembled(value: pa.DataType, id_type: pa.DataType, out: str):
    """Rows (_id, out, _whole) of blocks: a block's answers come first, part by part, then its packed rows. Whole rows hold no null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, answers = None, []
        for batch in batches:
            for i, (b, side) in enumerate(zip(batch["_block"].to_pylist(), batch["_side"].to_pylist(), strict=True)):
                if b != block:
                    block, answers = b, []
                if side == 0:
                    answers.append(_read(batch["_what"][i]).column(0))
                    continue
                which, sizes = _numbers(batch["_parts"][i]), _numbers(batch["_sizes"][i])
                places = _numbers(batch["_high"][i]).astype(np.uint32) << np.uint32(16) | _numbers(batch["_low"][i])
                row = np.full(len(which) + 1, -1, np.int32)  # of a key's place among the answers
                row[np.argsort(which, kind="stable") + 1] = np.arange(len(which), dtype=np.int32)
                found = row[places]
                table = pa.concat_arrays(answers) if answers else pa.array([], value)
                flat = table.take(pa.array(found, mask=found < 0))
                ends = np.r_[0, np.cumsum(sizes)].astype(np.int32)
                gone = np.r_[0, np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))][ends]
                lists = pa.ListArray.from_arrays(pa.array(ends), flat)
                made = pa.RecordBatch.from_arrays([_read(batch["_ids"][i]).column(0), lists, pa.array(np.diff(gone) == 0)], schema=pa.schema([("_id", id_type), (out, lists.type), ("_whole", pa.bool_())]))
                answers = []
                del which, sizes, places, row, found, table, flat, ends, gone, lists
                yield made  # of as many rows as a block

    return run


def _lookup_in_blocks(rows: DataFrame, id_col: str, keys: Column, entries: DataFrame, out: str, missing: Column | None = None) -> DataFrame:
    """(id_col, out): for each row's array of whole-number keys the entries' (key, value) values, ``missing`` or null where there is none.

    Rows are packed in blocks: a block's distinct keys, and a number of two to four bytes in the place of each key. A block
    asks each part of the key space for all its distinct keys there at once, a part answers from its sorted entries, and
    the packed blocks move once to meet their answers. So no row stands for a single key, in a join or in a shuffle.
    """
    spark = rows.sparkSession
    asking = rows.select(F.col(id_col).alias("_id"), F.coalesce(keys, F.array()).cast("array<long>").alias("_keys"))
    entries = entries.select(F.col("key").cast("long").alias("key"), "value").where(F.col("key").isNotNull())
    kind, id_kind = entries.schema["value"].dataType, asking.schema["_id"].dataType
    parts = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries.count() // PART_ENTRIES)), 1 << 16)
    packed = ["_ids", "_sizes", "_parts", "_low", "_high"]
    blocks = "_block long, " + ", ".join(f"{c} binary" for c in ("_ids", "_sizes", "_keys", "_parts", "_low", "_high"))
    stored = cut_lineage(asking.mapInArrow(_frugal(_packed_rows(1 << BLOCK_BITS, parts)), blocks), "asking-rows")
    asks = "_part int, _side int, _block long, _what binary"
    asked = entries.mapInArrow(_frugal(_packed_entries(parts)), asks).unionByName(stored.select("_block", "_keys", "_parts").mapInArrow(_asked, asks))
    asked = asked.repartitionById(parts, F.col("_part")).sortWithinPartitions("_part", "_side")
    answers = asked.mapInArrow(_frugal(_answered(to_arrow_type(kind))), "_block long, _part int, _what binary")
    none = F.lit(None).cast("binary")
    both = answers.select("_block", F.lit(0).alias("_side"), "_part", "_what", *[none.alias(c) for c in packed]).unionByName(
        stored.select("_block", F.lit(1).alias("_side"), F.lit(None).cast("int").alias("_part"), none.alias("_what"), *packed))
    both = both.repartition("_block").sortWithinPartitions("_block", "_side", "_part")
    found = both.mapInArrow(_frugal(_assembled(to_arrow_type(kind), to_arrow_type(id_kind), out)), f"_id {id_kind.simpleString()}, {out} array<{kind.simpleString()}>, _whole boolean")
    if missing is None:
        return found.select(F.col("_id").alias(id_col), out)
    filled = F.when(F.col("_whole"), F.col(out)).otherwise(F.transform(out, lambda x: F.coalesce(x, missing)))
    return found.select(F.col("_id").alias(id_col), filled.alias(out))


def lookup_ids(rows: DataFrame, vocab: DataFrame, id_col: str, tokens: str = "tokens",
               unk_id: int | None = None, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """J6 piece -> id, in place: (id_col, ids), one row per input row, empty arrays included.

    A token without an entry gets ``unk_id``; without ``unk_id`` it is an error. Entries are found
    by binary search in the sorted 64-bit hashes of the vocabulary (checked to be distinct).
    """
    entries = cut_lineage(vocab.select("token", F.col("id").cast("long").alias("tid"), F.xxhash64("token").alias("h")), "vocabulary")
    missing = F.lit(unk_id).cast("long") if unk_id is not None else F.raise_error(F.lit("a token has no entry in the vocabulary")).cast("long")
    if entries.count() <= max_entries:
        table = entries.select("h", "tid").orderBy("h").toArrow()
        hashes, ids = (table[c].to_numpy() for c in ("h", "tid"))
        if not (hashes[1:] == hashes[:-1]).any():
            shared = rows.sparkSession.sparkContext.broadcast((hashes, ids))

            def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
                keys, values = shared.value
                for lists in batches:
                    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                    if not len(keys):
                        yield _list_of(np.full(len(x), -1), lists)
                        continue
                    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
                    yield _list_of(np.where(keys[at] == x, values[at], -1), lists)

            hashed = F.transform(F.coalesce(F.col(tokens), F.array().cast("array<string>")), lambda t: F.xxhash64(t))
            found = rows.select(F.col(id_col), F.arrow_udf(find, "array<long>")(hashed).alias("ids"))
            return found.select(id_col, F.transform("ids", lambda i: F.when(i >= 0, i).otherwise(missing)).alias("ids"))
    hashed = F.transform(tokens, lambda t: F.xxhash64(t))
    if entries.groupBy("h").count().where(F.col("count") > 1).isEmpty():
        return _lookup_in_blocks(rows, id_col, hashed, entries.select(F.col("h").alias("key"), F.col("tid").alias("value")), "ids", missing)
    # Two tokens share a hash, or a token has two entries: join on the token (AQE splits hot ones) and gather by row number.
    keyed = cut_lineage(rows.select(F.col(id_col), F.col(tokens).alias("_t"), F.monotonically_increasing_id().alias("_row")), "tokens")
    occ = keyed.select("_row", F.posexplode("_t").alias("pos", "token"))
    got = occ.join(entries.select("token", "tid"), "token", "left").withColumn("tid", F.coalesce("tid", missing))
    ids = (got.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("pos", "tid"))).alias("_p"))
              .select("_row", F.transform("_p", lambda s: s["tid"]).alias("ids")))
    return keyed.join(ids, "_row", "left").select(id_col, F.coalesce("ids", F.array().cast("array<long>")).alias("ids"))


def lookup_pieces(ids_df: DataFrame, vocab: DataFrame, id_col: str, ids_col: str = "ids",
                  unk: str | None = None, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """J6 id -> piece, in place: (id_col, pieces); an id without an entry gives ``unk``, or is an error without it."""
    entries = cut_lineage(vocab.select("token", F.col("id").cast("long").alias("tid")), "vocabulary")
    missing = F.lit(unk) if unk is not None else F.raise_error(F.lit("an id has no entry in the vocabulary")).cast("string")
    n, size = entries.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("token")), F.lit(0))).first()
    wanted = F.coalesce(F.col(ids_col).cast("array<long>"), F.array().cast("array<long>"))
    if n <= max_entries and size <= MAX_PIECE_BYTES:
        table = entries.orderBy("tid").toArrow()
        shared = ids_df.sparkSession.sparkContext.broadcast((table["tid"].to_numpy(), table["token"].combine_chunks()))

        def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            keys, pieces = shared.value
            for lists in batches:
                x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                at = np.minimum(np.searchsorted(keys, x), max(len(keys) - 1, 0))
                known = keys[at] == x if len(keys) else np.zeros(len(x), bool)
                offsets = lists.offsets.to_numpy()
                yield pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pieces.take(pa.array(at, mask=~known)))

        found = ids_df.select(F.col(id_col), F.arrow_udf(find, "array<string>")(wanted).alias("pieces"))
        return found.select(id_col, F.transform("pieces", lambda p: F.coalesce(p, missing)).alias("pieces"))
    return _lookup_in_blocks(ids_df, id_col, wanted, entries.select(F.col("tid").alias("key"), F.col("token").alias("value")), "pieces", missing)


def distinct_words(rows: DataFrame) -> DataFrame:
    """Distinct pre-tokens with their counts and byte-symbol form."""
    return token_counts(rows).withColumn("sym", T.byte_symbols("token"))


def pair_counts(rows: DataFrame) -> DataFrame:
    """Neighbouring symbol pairs (set per word) weighted by word frequency."""
    # one-byte words have no pairs
    multi = token_counts(rows).filter(F.octet_length("token") > 1)
    w = multi.withColumn("sym", T.byte_symbols("token")).select("count", T.word_symbols("sym").alias("s"))
    n = F.size("s")
    pairs = F.array_distinct(F.arrays_zip(F.slice("s", 1, n - 1).alias("left"),
                                          F.slice("s", 2, n - 1).alias("right")))
    return (w.select("count", F.explode(pairs).alias("p"))
             .groupBy(F.col("p.left").alias("left"), F.col("p.right").alias("right"))
             .agg(F.sum("count").alias("count")))


#: Packed words of one state row, merges applied anew to a stored state before it is written again, pairs seen at once.
BLOCK_WORDS, RESTATE, TOP_PAIRS = 4_096, 16, 1_024
_CODE = 22  # bits of a symbol's code in a packed (word, left, right)


def _packed_words(rows: DataFrame) -> DataFrame:
    """Blocks of distinct words: codes of their symbols, where each word ends, how often it occurs."""
    code = {b: i for i, (b, _) in enumerate(T.byte_table())}
    of_byte = np.array([code[b] for b in range(256)], "<i4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_WORDS):
                batch = whole.slice(at, BLOCK_WORDS)
                words = [w.encode("utf-8") for w in batch.column("token").to_pylist()]
                ends = np.cumsum(list(map(len, words)))
                codes = of_byte[np.frombuffer(b"".join(words), np.uint8)]
                codes[ends - 1] += 256  # the last symbol carries the end of the word
                counts = batch.column("count").to_numpy().astype("<i8")
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (codes, ends.astype("<i8"), counts)], names=["codes", "ends", "counts"])

    words = token_counts(rows).where(F.octet_length("token") > 0)
    return words.select("token", "count").mapInArrow(run, "codes binary, ends binary, counts binary")


def merge_codes(codes: np.ndarray, word: np.ndarray, merges: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and their words after merging the pairs (left, right, new), no two of which can overlap."""
    keys = np.array([a << 32 | b for a, b, _ in merges], np.int64)
    order = np.argsort(keys)
    keys, made = keys[order], np.array([c for _, _, c in merges], codes.dtype)[order]
    pair = codes[:-1].astype(np.int64) << 32 | codes[1:]
    at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
    hit = np.flatnonzero((keys[at] == pair) & (word[:-1] == word[1:]))
    # Neighbouring hits are one pair of equal symbols, as in "aaaa": every other one merges, from the left.
    first = np.diff(hit, prepend=-2) != 1
    hit = hit[(np.arange(len(hit)) - np.flatnonzero(first)[np.cumsum(first) - 1]) % 2 == 0] if len(hit) else hit
    codes = codes.copy()
    codes[hit] = made[at[hit]]
    keep = np.ones(len(codes), bool)
    keep[hit + 1] = False
    return codes[keep], word[keep]


def _pairs_in(codes: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Packed (word, left, right), once for each pair of a word."""
    inside = np.flatnonzero(word[:-1] == word[1:])
    return np.unique(word[inside] << 2 * _CODE | codes[inside].astype(np.int64) << _CODE | codes[inside + 1])


def next_merges(top: list[tuple[str, str, int]], seen: set[str], whole: bool, most: int) -> list[tuple[str, str]]:
    """The next merges, from the most frequent pairs (left, right, count) in order: those that a learner of one merge a round takes.

    A pair joins the round if no chosen merge changes its count or makes a pair that comes before it. A new pair
    (x, lr) is no more frequent than (x, l), and (lr, y) no more than (r, y); such a pair stands behind the candidate,
    or it would have ended the round. It ends on a tie as well, and behind a merge that makes a known symbol or doubles one.
    ``whole``: no further pairs exist behind ``top``.
    """
    lefts: set[str] = set()
    rights: set[str] = set()
    out: list[tuple[str, str]] = []
    for left, right, n in top:
        if out:
            tied = [x for x in top if x[2] == n]
            if left in rights or right in lefts or any(b in lefts or a in rights for a, b, _ in tied) or (not whole and tied[-1] == top[-1]):
                break
        out.append((left, right))
        lefts.add(left)
        rights.add(right)
        if len(out) == most or left == right or left + right in seen:
            break
        seen = seen | {left + right}
    return out


def learn_merges(rows: DataFrame, n: int) -> DataFrame:
    """F-merges: (rank, left, right), ``n`` merges at most, each the most frequent pair (ties: left, right) after those before it.

    A pair counts once in a word, weighted by the word's frequency. Distinct words lie packed in a stored table. A round
    takes all merges that do not touch each other (``next_merges``), and one pass finds the words that
    hold their pairs; only those words give changes of pair counts, which are added to the counts before. The driver
    holds the merges and the most frequent pairs of a round. Fewer than ``n`` merges come where no pair is left.
    """
    spark = rows.sparkSession
    state = cut_lineage(_packed_words(rows), "words")
    names = [s for _, s in T.byte_table()]
    names += [s + "</w>" for s in names]
    code = {s: i for i, s in enumerate(names)}
    merges: list[tuple[str, str]] = []
    pending: list[list[tuple[int, int, int]]] = []  # rounds since the state was written

    def unpack(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes, ends, counts = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in (("codes", "<i4"), ("ends", "<i8"), ("counts", "<i8")))
        return codes, np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)), counts

    def changes(before: list, now: list):
        """Changes of the pair counts by the merges ``now`` on top of ``before``; without ``now`` the counts themselves."""
        table = np.array(names, object)
        chosen = np.array([a << 32 | b for a, b, _ in now], np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for batch in batches:
                for i in range(batch.num_rows):
                    codes, word, counts = unpack(batch, i)
                    for done in before:
                        codes, word = merge_codes(codes, word, done)
                    parts = []
                    if now:
                        held = np.isin(codes[:-1].astype(np.int64) << 32 | codes[1:], chosen) & (word[:-1] == word[1:])
                        some = np.isin(word, word[:-1][held])  # only words that hold a chosen pair
                        codes, word = codes[some], word[some]
                        parts.append((_pairs_in(codes, word), -1))
                        codes, word = merge_codes(codes, word, now)
                    parts.append((_pairs_in(codes, word), 1))
                    for p, sign in parts:
                        keys.append(p & (1 << 2 * _CODE) - 1)
                        sums.append(sign * counts[p >> 2 * _CODE])
                if len(keys) > 64:
                    keys, sums = ([x] for x in _summed(keys, sums))
            pairs, total = _summed(keys, sums)
            left, right = (pa.array(table[x], pa.string()) for x in (pairs >> _CODE, pairs & (1 << _CODE) - 1))
            yield pa.RecordBatch.from_arrays([left, right, pa.array(total)], names=["left", "right", "n"])

        return state.mapInArrow(run, "left string, right string, n long")

    def restated(before: list):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    codes, word, counts = unpack(batch, i)
                    for done in before:
                        codes, word = merge_codes(codes, word, done)
                    ends = np.searchsorted(word, np.arange(len(counts)), "right")
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (codes, ends.astype("<i8"), counts)], names=["codes", "ends", "counts"])

        return state.mapInArrow(run, "codes binary, ends binary, counts binary")

    counts = cut_lineage(changes([], []).groupBy("left", "right").agg(F.sum("n").alias("n")), "pair-counts")
    while len(merges) < n:
        top = [(r["left"], r["right"], r["n"]) for r in counts.where(F.col("n") > 0).orderBy(F.desc("n"), "left", "right").limit(TOP_PAIRS).collect()]
        chosen = next_merges(top, set(code), len(top) < TOP_PAIRS, n - len(merges))
        if not chosen:
            break
        merges += chosen
        for left, right in chosen:
            if left + right not in code:
                code[left + right] = len(names)
                names.append(left + right)
        if len(merges) == n:
            break
        now = [(code[a], code[b], code[a + b]) for a, b in chosen]
        counts = cut_lineage(counts.unionByName(changes(list(pending), now)).groupBy("left", "right").agg(F.sum("n").alias("n")), "pair-counts")
        pending.append(now)
        if len(pending) == RESTATE:
            state, pending = cut_lineage(restated(list(pending)), "words"), []
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(merges)], "rank long, left string, right string")


def _summed(keys: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    pairs, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(pairs), np.int64)
    np.add.at(total, place, np.concatenate(sums))
    return pairs[total != 0], total[total != 0]


def bpe_word(sym: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """Merge the best-ranked neighbouring pair until none is left."""
    word = list(sym)
    if not word:
        return []
    word[-1] = word[-1] + "</w>"
    while len(word) > 1:
        best, best_rank = None, None
        for pair in zip(word, word[1:]):
            r = ranks.get(pair)
            if r is not None and (best_rank is None or r < best_rank):
                best, best_rank = pair, r
        if best is None:
            break
        merged, i = [], 0
        while i < len(word):
            if i + 1 < len(word) and word[i] == best[0] and word[i + 1] == best[1]:
                merged.append(word[i] + word[i + 1])
                i += 2
            else:
                merged.append(word[i])
                i += 1
        word = merged
    return word


def vocab_pieces(merges: list[tuple[str, str]]) -> list[str]:
    """The id order of the subword vocabulary: byte symbols, the same with '</w>', merges, specials."""
    base = [s for _, s in T.byte_table()]
    return base + [s + "</w>" for s in base] + [a + b for a, b in merges] + ["<|startoftext|>", "<|endoftext|>"]


def merge_list(merges) -> list[tuple[str, str]]:
    """The merge table as an ordered list (a model parameter, its bytes checked)."""
    if isinstance(merges, list):
        return merges
    size = merges.agg(F.sum(F.octet_length("left") + F.octet_length("right"))).first()[0] or 0
    if size > MAX_MERGE_BYTES:
        raise ValueError(f"merges of {size} bytes exceed the checked bound {MAX_MERGE_BYTES}")
    rows = merges.select("rank", "left", "right").collect()
    return [(r.left, r.right) for r in sorted(rows, key=lambda r: r["rank"])]


def bpe_encode(rows: DataFrame, merges) -> DataFrame:
    """(token, pieces, piece_ids) for every distinct pre-token."""
    mlist = merge_list(merges)
    ranks = {p: i for i, p in enumerate(mlist)}
    ids = {p: i for i, p in enumerate(vocab_pieces(mlist))}

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            pieces = [bpe_word(s, ranks) for s in pdf["sym"]]
            yield pd.DataFrame({"token": pdf["token"], "pieces": pieces,
                                "piece_ids": [[ids[p] for p in ps] for ps in pieces]})

    words = distinct_words(rows).select("token", "sym")
    return words.mapInPandas(run, "token string, pieces array<string>, piece_ids array<long>")


def encode(docs: DataFrame, id_col: str, text_col: str, merges) -> DataFrame:
    """Text -> subword ids, a row for every text: clean, lower, pre-tokenise, byte symbols, BPE, ids.

    The merges go to the tasks; each worker encodes a distinct token of its texts once.
    """
    mlist = merge_list(merges)
    shared = docs.sparkSession.sparkContext.broadcast(mlist)
    symbol_of = dict(T.byte_table())

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ranks = {p: i for i, p in enumerate(shared.value)}
        ids = {p: i for i, p in enumerate(vocab_pieces(shared.value))}
        known: dict[str, list[int]] = {}
        for lists in batches:
            flat = lists.flatten().dictionary_encode()
            words = flat.dictionary.to_pylist()
            if len(known) + len(words) > 500_000:  # bounds memory; a forgotten word is encoded again
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = [ids[p] for p in bpe_word("".join(symbol_of[b] for b in w.encode("utf-8")), ranks)]
            codes = flat.indices.to_numpy(zero_copy_only=False)
            parts = [known[w] for w in words]
            sizes = np.array(list(map(len, parts)), np.int64)
            table = np.array([i for p in parts for i in p], np.int64)
            each = sizes[codes] if len(words) else np.zeros(0, np.int64)
            ends = np.cumsum(each)
            starts = (np.cumsum(sizes) - sizes)[codes] if len(words) else each
            values = table[np.repeat(starts - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)] if len(words) else table
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            yield pa.ListArray.from_arrays(pa.array(np.r_[0, ends][offsets], pa.int32()), pa.array(values))

    return tokenize(docs, id_col, text_col).select(id_col, F.arrow_udf(run, "array<long>")(F.col("tokens")).alias("ids"))


def decode_column(merges):
    """A function turning an ids array into text ('</w>' -> space, bad bytes replaced).

    The bytes of all pieces are taken from one table and joined per row; a null array stays null.
    """
    back = {s: b for b, s in T.byte_table()}
    table = [bytes(back[c] for c in piece) for piece in vocab_pieces(merge_list(merges))]

    def run(lists: pa.Array) -> pa.Array:
        pieces = pa.array(table, pa.binary()).take(lists.flatten())
        offsets = lists.offsets.to_numpy()
        rows = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pieces), b"")
        return pa.array([x.decode("utf-8", errors="replace").replace("</w>", " ") for x in rows.to_pylist()], pa.string())

    def dec(ids):
        return F.when(ids.isNotNull(), F.arrow_udf(run, "string")(F.coalesce(ids, F.array()).cast("array<long>")))

    return dec


def tokenize_pad(df: DataFrame, ids_col: str, max_len: int | None, padding: str = "none", pad_id: int = 1,
                 batch_col: str | None = None, multiple: int | None = None) -> DataFrame:
    """Truncate to ``max_len`` (None: whole rows); padding 'none', 'max_length' or 'longest' (in the batch).

    'longest' uses a window over the batch, a group bounded by the batch size.
    """
    out = df if max_len is None else df.withColumn(ids_col, T.truncate_ids(ids_col, max_len))
    if padding == "max_length":
        if max_len is None:
            raise ValueError("padding='max_length' needs a length")
        return out.withColumn(ids_col, T.pad_to(ids_col, T.round_up(F.lit(max_len), multiple), pad_id))
    if padding == "longest":
        if batch_col is None:
            raise ValueError("padding='longest' needs a batch column")
        width = T.round_up(F.max(F.size(ids_col)).over(Window.partitionBy(batch_col)), multiple)
        return out.withColumn(ids_col, T.pad_to(ids_col, width, pad_id))
    if padding != "none":
        raise ValueError(f"unknown padding {padding!r}")
    return out
