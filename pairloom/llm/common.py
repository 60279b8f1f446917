"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Characters between words: space and tab to carriage return. ``bytes.split()`` splits at exactly these.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"

#: Rows handled at once inside a task, so that one Arrow batch of long texts is not held as objects.
SLICE = 256


def slices(batch, rows: int = SLICE) -> Iterator:
    """Cut an Arrow record batch into pieces of at most ``rows`` rows (views, no copy)."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, as UTF-8 bytes; null has none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def hash64(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Memo(dict):
    """``memo[key]`` computes a missing value with ``make`` and keeps it; emptied when ``limit`` keys are held.

    The limit bounds memory only: a forgotten value is computed again.
    """

    def __init__(self, make, limit: int = 200_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


def held_out(id_col: str, mod: int, rest: int) -> Column:
    """crc32 of the id as text, mod ``mod``, is ``rest``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod == rest


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once into a table in the shared checkpoint folder and read back.

    Later passes scan stored rows, and a lost executor restarts from them.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of text that a training sample brings to the driver at most.
SAMPLE_BYTES = 64 << 20


def one_text_each(rows: DataFrame, key: list[str], more: list[str]) -> DataFrame:
    """Of the rows of a key the one whose ``text`` has the lowest hash (null: none); partial minima meet, no group is held."""
    of = F.struct(F.xxhash64("text").alias("th"), "text", *more)
    return rows.where(F.col("text").isNotNull()).groupBy(*key).agg(F.min(of).alias("_llm_m")).select(*key, "_llm_m.text", *[f"_llm_m.{c}" for c in more])


def fit_sample(rows: DataFrame, label: str, fit, limit: int | None = None):
    """``fit(texts, labels)`` on rows (doc, text, ``label``, _llm_h) in the order of ``_llm_h``, while their bytes stay within the limit.

    The sizes come first, so that the driver never holds more text than that.
    """
    rows = stored(rows, "training-sample")
    sizes = sorted(tuple(r) for r in rows.select("_llm_h", F.col("doc").cast("string"), F.octet_length("text")).collect())
    held, last = 0, None
    for h, _, n in sizes:
        held += n
        if held > (SAMPLE_BYTES if limit is None else limit):
            break
        last = h
    sample = rows.where(F.lit(False) if last is None else F.col("_llm_h") <= last).collect()
    sample.sort(key=lambda r: (r["_llm_h"], str(r["doc"]), r["text"]))
    return fit([r["text"] for r in sample], [r[label] for r in sample])


def join_counted(rows: DataFrame, keys: DataFrame, on: list[str], count: str, total: int, spread: Column, how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``keys``, which hold each key once with its number of rows in the column ``count``.

    A key with more than a thousandth of the ``total`` rows (1 000 at least) meets its rows in several places, as
    ``spread`` (an integer of the row) decides. There are 1 000 such keys at most, so they are broadcast.
    """
    least = max(1_000, total // 1_000)
    places = F.ceil(F.col(count) / F.lit(least)).cast("int")
    hot = keys.where(F.col(count) > least).select(*on, places.alias("_llm_places"))
    place = F.when(F.col("_llm_places").isNotNull(), F.pmod(spread, F.col("_llm_places")).cast("int")).otherwise(F.lit(0))
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("_llm_place", place).drop("_llm_places")
    copies = keys.withColumn("_llm_place", F.explode(F.sequence(F.lit(0), F.greatest(places - 1, F.lit(0))))).drop(count)
    return dealt.join(copies, [*on, "_llm_place"], how).drop("_llm_place")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
