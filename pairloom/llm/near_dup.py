"""MinHash near-duplicates (10) with sequential Bayesian verification.

1. Every text becomes its set of word shingles (64-bit hashes of whole shingles) and a 128-bit digest
   of that set. Rows with one digest are one class; all later work is on classes.
2. Banded MinHash signatures put classes into buckets. In each bucket one hub (the smallest class by
   hash) meets the others: pairs grow with the members, not with their square.
3. A pair's signatures are compared batch by batch. Under a uniform prior the posterior probability of
   similarity >= t after m of n equal values is P(Binomial(n + 1, t) <= m); a pair below ``miss`` is pruned.
4. Survivors are verified on their full sets. First each class only with its most similar hub, then,
   if that has not connected them, with the others. Confirmed links merge components.
5. Buckets whose classes are then all connected are done. In the others every pair of classes that are not
   connected yet still has to be compared, or links would be lost. A bucket of more than one block is first
   split: two sets at the threshold share one of their rarest shingles (as many as one set may lack, and one), in
   whatever order all sets agree on, so classes that no chain of such shared shingles connects need no comparison. What
   is left is cut into blocks; a task holds two blocks, compares their signatures in numpy and verifies survivors
   as long as they are unconnected. Only confirmed links leave the task, at most one per class: no pairs are emitted.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import broadcast_if_small
from .common import Memo, hash64, join_counted, mix64, slices, stored
from .graph import components

#: For a similarity of 0.8: a pair at the threshold shares no band with probability (1 - 0.8 ** 5) ** 24 = 7e-5.
BANDS, ROWS = 24, 5
BATCH = 24
#: Chosen probability that a pair at the threshold is pruned unverified.
MISS = 1e-6
#: Members of a block, and bytes of their texts, about: a task holds two blocks.
BLOCK_ROWS, BLOCK_BYTES = 1024, 8 << 20
#: Bytes of bucket keys or class digests that may be broadcast; beyond, rows are shuffled to them.
BROADCAST_BYTES = 32 << 20
#: Counters that order shingles by frequency (2 ** COUNTER_BITS); shingles that share one are ordered less well, never lost.
COUNTER_BITS = 17
#: Pairs that meet one row in one place, at least; of more pairs than that, a hundred-thousandth.
HOT = 1_000

_MASK = (1 << 64) - 1
_odd = lambda k: (hash64(b"pairloom-%d" % k) | 1) & _MASK


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    return (np.array([_odd(2 * k) for k in range(n)], np.uint64)[:, None],
            np.array([_odd(2 * k + 1) for k in range(n)], np.uint64)[:, None])


def normal_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased (``bytes.lower`` changes only these), cut into words."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(words: list[bytes], size: int, memo: dict) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; fewer words are one shingle; no words, none."""
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    h = np.full(len(words) - width + 1, width, np.uint64)
    for j in range(width):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + ids[j: len(ids) - width + 1 + j])
    return np.unique(h)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash values (uint32); long sets are taken piece by piece."""
    best = None
    for at in range(0, len(shingles), 4096):
        low = (a * shingles[None, at: at + 4096] + b).min(axis=1)
        best = low if best is None else np.minimum(best, low)
    return (best >> np.uint64(32)).astype(np.uint32)


def least_matches(threshold: float, n_hashes: int, batch: int, miss: float) -> list[tuple[int, int]]:
    """After each batch of n values: (n, fewest matches at which P(similarity >= threshold) is still >= miss)."""
    out = []
    for n in range(batch, n_hashes + 1, batch):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def _sets(docs: DataFrame, id_col: str, text: str, size: int, bands: int, rows: int) -> DataFrame:
    a, b = _family(bands * rows)

    def emit(batches):
        memo = Memo(hash64)
        salt = np.arange(1, bands + 1, dtype=np.uint64)
        for batch in batches:
            for part in slices(batch):
                out: list[list] = [[], [], [], [], []]
                for t in part.column(1).to_pylist():
                    words = normal_words(t)
                    s = shingle_set(words, size, memo)
                    out[0].append(len(s))
                    if not len(s):
                        for o in out[1:]:
                            o.append(None)
                        continue
                    sig = signature(s, a, b)
                    key = salt.copy()
                    for j in range(rows):
                        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + sig[j::rows].astype(np.uint64))
                    out[1].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    out[2].append(sig.tobytes())
                    out[3].append(key.view(np.int64))
                    out[4].append(b" ".join(words).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary()),
                     pa.array(out[3], pa.list_(pa.int64())), pa.array(out[4], pa.string())],
                    names=["id", "text_hash", "n", "digest", "sig", "keys", "body"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(
        emit, f"id {kind}, text_hash long, n long, digest binary, sig binary, keys array<long>, body string")


def _met(pairs: DataFrame, rows, least: int) -> DataFrame:
    """``pairs`` (a, b) with the columns of ``rows("a")`` and ``rows("b")``; a ``b`` of more than ``least`` pairs meets them in several places."""
    hot = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / least).cast("int").alias("places")).where(F.col("places") > 1)
    hot, _ = _shipped(hot, 32)
    places = F.coalesce("places", F.lit(1))
    dealt = pairs.join(hot, "b", "left").withColumn("place", F.pmod(F.xxhash64("a"), places).cast("int")).drop("places")
    copies = rows("b").join(hot, "b", "left").withColumn("place", F.explode(F.sequence(F.lit(0), places - 1))).drop("places")
    return dealt.join(rows("a"), "a").join(copies, ["b", "place"])


def _pruned(pairs: DataFrame, sigs: DataFrame, threshold: float, n_hashes: int, miss: float, least: int) -> DataFrame:
    """Pairs (a, b) that survive the sequential comparison, with the share of equal values."""
    steps = least_matches(threshold, n_hashes, BATCH, miss)
    slack = 1e-9

    def compare(batches):
        for batch in batches:
            for part in slices(batch, 4096):
                left, right, na, nb = (part.column(i) for i in (2, 3, 4, 5))
                na, nb = na.to_numpy(zero_copy_only=False), nb.to_numpy(zero_copy_only=False)
                x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint32).reshape(-1, n_hashes) for c in (left, right))
                live = np.flatnonzero(np.minimum(na, nb) + slack >= threshold * np.maximum(na, nb))
                equal = np.zeros(len(live), np.int64)
                for n, fewest in steps:
                    equal += (x[live, n - BATCH: n] == y[live, n - BATCH: n]).sum(axis=1)
                    keep = equal >= fewest
                    live, equal = live[keep], equal[keep]
                at = pa.array(live)
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(equal / n_hashes)], names=["a", "b", "est"])

    s = lambda x: sigs.select(F.col("digest").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n").alias(f"n_{x}"))
    both = _met(pairs, s, least).select("a", "b", "sig_a", "sig_b", "n_a", "n_b")
    return both.mapInArrow(compare, "a binary, b binary, est double")


def _confirmed(pairs: DataFrame, bodies: DataFrame, size: int, percent: int, least: int) -> DataFrame:
    """Pairs whose full shingle sets have 100 * intersection >= percent * union."""

    def verify(batches):
        memo = Memo(hash64)
        sets = Memo(lambda body: shingle_set(body.encode().split(), size, memo), limit=64)
        for batch in batches:
            for part in slices(batch, 64):
                keep = []
                for i, (x, y) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    p, q = sets[x], sets[y]
                    common = len(np.intersect1d(p, q, assume_unique=True))
                    if 100 * common >= percent * (len(p) + len(q) - common):
                        keep.append(i)
                at = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at)], names=["a", "b"])

    t = lambda x: bodies.select(F.col("digest").alias(x), F.col("body").alias(f"body_{x}"))
    both = _met(pairs.select("a", "b"), t, least).select("a", "b", "body_a", "body_b")
    return both.mapInArrow(verify, "a binary, b binary")


def _parts(members: DataFrame, size: int, percent: int) -> DataFrame:
    """(digest, part) of ``members`` (digest, root, body): only classes of one part can be linked; who shares nothing is left out.

    Of a set of n shingles any other at the threshold holds percent * n / 100 at least, so in any order common to all
    sets the first shingles, one more than the others, meet those of the other set. The order is by frequency (counted
    over all members in hashed counters), then by hash: shingles of a template come last.
    """
    of = lambda batch, memo: (shingle_set((b or "").encode().split(), size, memo) for b in batch.column(2).to_pylist())
    shift = np.uint64(64 - COUNTER_BITS)

    def count(batches):
        memo = Memo(hash64)
        total = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in batches:
            for part in slices(batch):
                for s in of(part, memo):
                    np.add.at(total, (s >> shift).astype(np.int64), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["counter", "n"])

    seen = np.zeros(1 << COUNTER_BITS, np.int64)
    for r in members.mapInArrow(count, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).collect():
        seen[r["counter"]] = r["n"]

    def rarest(batches):
        memo = Memo(hash64)
        for batch in batches:
            for part in slices(batch):
                first = []
                for s in of(part, memo):
                    order = np.lexsort((s, seen[(s >> shift).astype(np.int64)]))
                    first.append(s[order[: len(s) + 1 - -(-percent * len(s) // 100)]].view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(first, pa.list_(pa.int64()))],
                                                 names=["digest", "root", "first"])

    first = members.mapInArrow(rarest, "digest binary, root binary, first array<long>").select("digest", "root", F.explode("first").alias("s"))
    first = stored(first, "rarest-shingles")
    met = first.groupBy("s").agg(F.min("digest").alias("x"), F.min("root").alias("r"), F.max("root").alias("q"), F.count(F.lit(1)).alias("n"))
    met = stored(met.where(F.col("r") != F.col("q")).select("s", "x", "n"), "shared-shingles")
    edges = join_counted(first.select("digest", "s"), met, ["s"], "n", first.count(), F.xxhash64("digest")).select("digest", "x").distinct()
    return components(edges, "digest", "x").select(F.col("node").alias("digest"), F.xxhash64("root").alias("part"))


def _unconnected(rows: DataFrame, size: int, percent: int, n_hashes: int, miss: float) -> DataFrame:
    """Links (a, b) between classes of different roots that meet in a (key, part, bi, bj) block pair, confirmed on full sets.

    A pair that shares several buckets is compared in the one of its first shared band only.
    """
    steps = least_matches(percent / 100, n_hashes, BATCH, miss)

    def survivors(left: dict, right: dict, same: bool):
        """(i, j) of the pairs that survive the comparison, most equal values first."""
        out = []
        step = max(1, (8 << 20) // (BATCH * max(1, len(right["n"]))))
        for at in range(0, len(left["n"]), step):
            cut = slice(at, at + step)
            n, m = left["n"][cut, None], right["n"][None, :]
            fits = (left["root"][cut, None] != right["root"][None, :]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            if same:
                fits &= np.arange(at, at + len(n))[:, None] < np.arange(len(right["n"]))[None, :]
            equal = (left["sig"][cut, None, :BATCH] == right["sig"][None, :, :BATCH]).sum(axis=2)
            i, j = np.nonzero(fits & (equal >= steps[0][1]))
            equal, i = equal[i, j], i + at
            for n_seen, least in steps[1:]:
                equal = equal + (left["sig"][i, n_seen - BATCH: n_seen] == right["sig"][j, n_seen - BATCH: n_seen]).sum(axis=1)
                keep = equal >= least
                i, j, equal = i[keep], j[keep], equal[keep]
            band = left["band"]
            first = ~(left["keys"][i, :band] == right["keys"][j, :band]).any(axis=1)
            out.append((i[first], j[first], equal[first]))
        i, j, equal = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(-equal, kind="stable")
        return zip(i[order].tolist(), j[order].tolist(), strict=True)

    def linked(group: list[dict], memo: dict) -> list[tuple[bytes, bytes]]:
        key, bi, bj = group[0]["key"], group[0]["bi"], group[0]["bj"]

        def side(block: int) -> dict:
            rows = [r for r in group if r["block"] == block]
            keys = np.array([r["keys"] for r in rows], np.int64).reshape(len(rows), -1)
            return {"n": np.array([r["n"] for r in rows]), "root": np.array([codes[r["root"]] for r in rows]), "keys": keys, "rows": rows,
                    "band": int(np.flatnonzero(keys[0] == key)[0]) if rows else 0,
                    "sig": np.frombuffer(b"".join(r["sig"] for r in rows), np.uint32).reshape(-1, n_hashes)}

        codes: dict[bytes, int] = {}
        for r in group:
            codes.setdefault(r["root"], len(codes))
        left = side(bi)
        right = left if bi == bj else side(bj)
        if not left["rows"] or not right["rows"]:
            return []
        parent = list(range(len(codes)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        sets = Memo(lambda body: shingle_set(body.encode().split(), size, memo), limit=2 * BLOCK_ROWS)
        out = []
        for i, j in survivors(left, right, bi == bj):
            x, y = left["rows"][i], right["rows"][j]
            u, v = find(codes[x["root"]]), find(codes[y["root"]])
            if u == v:
                continue
            p, q = sets[x["body"]], sets[y["body"]]
            common = len(np.intersect1d(p, q, assume_unique=True))
            if 100 * common >= percent * (len(p) + len(q) - common):
                parent[u] = v
                out.append((x["digest"], y["digest"]))
        return out

    def compare(batches):
        """Groups lie one after another; the last of an Arrow batch may go on in the next."""
        memo = Memo(hash64)
        group: list[dict] = []

        def flush(links: list) -> pa.RecordBatch:
            a, b = zip(*links, strict=True) if links else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

        for batch in batches:
            for part in slices(batch):
                links: list = []
                for r in part.to_pylist():
                    if group and any(r[k] != group[0][k] for k in ("key", "part", "bi", "bj")):
                        links += linked(group, memo)
                        group = []
                    group.append(r)
                yield flush(links)
        if group:
            yield flush(linked(group, memo))

    return rows.mapInArrow(compare, "a binary, b binary")


def _block_pairs(members: DataFrame) -> DataFrame:
    """Each member (key, part, digest, h, blocks) once for every pair of blocks (bi <= bj) that its own block is part of."""
    block = F.pmod(F.col("h"), F.col("blocks")).cast("int")
    pairs = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return pairs.withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")}).drop("other", "blocks", "h")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (digest, root) after the links (a, b): components of the links between roots, carried to every class."""
    if links.isEmpty():
        return roots
    r = lambda x: roots.select(F.col("digest").alias(x), F.col("root").alias(f"root_{x}"))
    merged = components(links.join(r("a"), "a").join(r("b"), "b").select("root_a", "root_b").distinct(), "root_a", "root_b")
    new = roots.join(merged.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
    return stored(new.select("digest", F.coalesce("to", "root").alias("root")), "roots")


def _shipped(rows: DataFrame, row_bytes: int) -> tuple[DataFrame, int]:
    return broadcast_if_small(rows, max_rows=BROADCAST_BYTES, row_bytes=row_bytes, max_bytes=BROADCAST_BYTES)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5,
                    percent: int = 80, bands: int = BANDS, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """One row per input row: ``id_col``, text_hash, n_shingles, digest, root, component_id, kept.

    Two rows are linked when 100 * |A & B| >= percent * |A | B| for their shingle sets. ``component_id`` is the
    smallest id reachable over links, ``root`` the digest that names the component, ``kept`` tells whether the
    row's id is its component's. A text that is null, empty or without words has an empty set: no links, its
    own id, kept. A row without id takes no part in linking: null component, kept. Rows that repeat an id
    are separate nodes unless their sets are equal. An empty table gives an empty table; other columns are ignored.
    """
    sets = stored(_sets(docs, id_col, text, shingle, bands, rows), "shingle-sets")
    known = sets.where(F.col("id").isNotNull() & F.col("digest").isNotNull())
    classes = stored(known.groupBy("digest").agg(F.min("id").alias("id")), "classes")
    # A key is shared when two sets have it; 64 bits of the digest tell that, combined before the shuffle.
    keyed = known.select("digest", "n", F.explode("keys").alias("key"))
    ends = keyed.withColumn("h", F.xxhash64("digest")).groupBy("key").agg(F.min("h").alias("x"), F.max("h").alias("y"))
    shared, _ = _shipped(stored(ends.where(F.col("x") != F.col("y")).select("key"), "shared-keys"), 16)
    member = stored(keyed.join(shared, "key").select("key", "digest", "n").distinct(), "bucket-members")
    member = member.withColumn("h", F.xxhash64("digest"))
    hubs = stored(member.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("h", "digest")).alias("hub"))
                  .select("key", "m", F.col("m").alias("times"), F.col("hub.digest").alias("hub")), "hubs")
    total = hubs.agg(F.sum("m")).first()[0] or 0
    least = max(HOT, total // 100_000)
    buckets = stored(join_counted(member, hubs, ["key"], "times", total, F.col("h")), "buckets")
    roots = stored(buckets.select("digest").distinct().select("digest", F.col("digest").alias("root")), "roots")
    # Few classes share a bucket: while they are few enough to ship, signatures and texts of the others do not move.
    # Keyed by digest and id, the copies of a hot class spread out; only the first of each class stays.
    candidates, _ = _shipped(roots.select("digest"), 32)
    chosen, _ = _shipped(stored(classes.join(candidates, "digest", "left_semi"), "candidate-classes"), 48)
    one = known.join(chosen, ["digest", "id"], "left_semi").dropDuplicates(["digest", "id"])
    full_rows = stored(one.select("digest", "n", "sig", "keys", "body"), "candidates")
    sigs, bodies = full_rows.select("digest", "n", "sig", "keys"), full_rows.select("digest", "body")

    # Every class of a bucket with the bucket's hub.
    pairs = buckets.where(F.col("digest") != F.col("hub")).select(F.col("digest").alias("a"), F.col("hub").alias("b")).distinct()
    alive = stored(_pruned(pairs, sigs, percent / 100, bands * rows, miss, least), "survivors")
    best = stored(alive.groupBy("a").agg(F.max_by("b", F.struct("est", "b")).alias("b")), "best-hubs")
    roots = _merged(roots, stored(_confirmed(best, bodies, shingle, percent, least), "links"))
    r = lambda x: roots.select(F.col("digest").alias(x), F.col("root").alias(f"r{x}"))
    rest = alive.join(best, ["a", "b"], "left_anti").join(r("a"), "a").join(r("b"), "b").where(F.col("ra") != F.col("rb")).select("a", "b")
    roots = _merged(roots, stored(_confirmed(stored(rest, "other-hubs"), bodies, shingle, percent, least), "links"))

    # Buckets of two are done; in larger ones whose classes are not all connected, every unconnected pair.
    named = stored(buckets.where(F.col("m") > 2).drop("hub").join(roots, "digest"), "rooted-buckets")
    size = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum(F.col("n") * 16) / BLOCK_BYTES)).cast("int")
    sized = lambda members, by: (members.groupBy(*by).agg(F.min("root").alias("x"), F.max("root").alias("y"), size.alias("blocks"))
                                 .where(F.col("x") != F.col("y")).select(*by, "blocks"))
    left = stored(sized(named, ["key"]), "open-buckets")
    named = named.drop("m")
    open_rows = named.join(left.where(F.col("blocks") == 1), "key").withColumn("part", F.lit(0).cast("long"))
    wide = left.where(F.col("blocks") > 1).select("key")
    if not wide.isEmpty():
        wide, _ = _shipped(wide, 16)
        members = stored(named.join(wide, "key"), "wide-buckets")
        parts = _parts(members.select("digest", "root").distinct().join(bodies, "digest"), shingle, percent)
        members = stored(members.join(parts, "digest"), "split-buckets")
        open_rows = open_rows.unionByName(members.join(sized(members, ["key", "part"]), ["key", "part"]))
    full = (_block_pairs(open_rows.drop("n")).join(full_rows, "digest").repartition("key", "part", "bi", "bj")
            .sortWithinPartitions("key", "part", "bi", "bj", "digest"))
    roots = _merged(roots, stored(_unconnected(full, shingle, percent, bands * rows, miss), "links"))

    named = classes.join(roots, "digest", "left").select("digest", "id", F.coalesce("root", "digest").alias("root"))
    smallest = named.groupBy("root").agg(F.min("id").alias("component_id"))
    named = stored(named.select("digest", "root").join(smallest, "root"), "component-ids")
    rows_out = sets.select("id", "text_hash", F.col("n").alias("n_shingles"), "digest").join(named, "digest", "left")
    component = F.when(F.col("id").isNull(), None).otherwise(F.coalesce("component_id", "id"))
    return rows_out.select(F.col("id").alias(id_col), "text_hash", "n_shingles", "digest", "root", component.alias("component_id"),
                           F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` less the near-duplicates: one row of each component stays, with all its columns.

    Rows of a component that share the kept id (repeated rows) are reduced to one as well.
    """
    marks = stored(near_duplicates(docs, id_col, text, **how), "near-duplicates")
    marks = marks.select(F.col(id_col).alias("_llm_id"), F.col("text_hash").alias("_llm_hash"), F.col("root").alias("_llm_root"), F.col("kept").alias("_llm_kept"))
    same = [F.col(id_col) == F.col("_llm_id"), F.xxhash64(text) == F.col("_llm_hash")]
    dropped, _ = _shipped(marks.where(~F.col("_llm_kept")).select("_llm_id", "_llm_hash").distinct(), 32)
    kept = docs.join(dropped, same, "left_anti")
    named = marks.where(F.col("_llm_kept") & F.col("_llm_root").isNotNull() & F.col("_llm_id").isNotNull())
    again = named.groupBy("_llm_root").agg(F.count(F.lit(1)).alias("_llm_n")).where(F.col("_llm_n") > 1).select("_llm_root")
    again = stored(named.join(again, "_llm_root", "left_semi").drop("_llm_kept").distinct(), "repeated-rows")
    if again.isEmpty():
        return kept
    one = kept.join(again, same).dropDuplicates(["_llm_root"]).select(*docs.columns)
    return kept.join(again, same, "left_anti").unionByName(one)
