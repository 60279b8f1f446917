"""User functions over column batches and corpus embedding.

The default encoder (hashed, signed token counts, L2-normalised) adds up codes that the JVM
makes; a user encoder runs in ``mapInPandas``, loaded once per
Python worker and fed Arrow batches.
"""

from __future__ import annotations

import hashlib
import re
import sys
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions import text as TX

DEFAULT_DIM = 64


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str,
                batch_size: int = 1000, remove_columns: Sequence[str] | None = None) -> DataFrame:
    """``fn`` on batches of ``batch_size`` rows; it may change row count and columns.

    Batches are formed inside each partition (Arrow batches re-chunked), so
    ``fn`` must not rely on which rows share a batch. With ``remove_columns``, ``fn`` sees all columns
    and the result keeps the input's columns other than those removed, next to what ``fn``
    returns (which wins on equal names); then ``fn`` must return a row per input row.
    """
    made = StructType.fromDDL(schema)
    kept = [] if remove_columns is None else [f for f in df.schema.fields if f.name not in remove_columns and f.name not in made.names]
    names = [f.name for f in kept]

    def apply(batch: pd.DataFrame) -> pd.DataFrame:
        out = fn(batch)
        if not names:
            return out
        if len(out) != len(batch):
            raise ValueError(f"{len(out)} rows from a batch of {len(batch)}: remove all columns to change the number of rows")
        return pd.concat([batch[names].reset_index(drop=True), out.reset_index(drop=True)], axis=1)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buf: list[pd.DataFrame] = []
        n = 0
        for pdf in it:
            buf.append(pdf)
            n += len(pdf)
            while n >= batch_size:
                allrows = pd.concat(buf, ignore_index=True)
                yield apply(allrows.iloc[:batch_size].reset_index(drop=True))
                rest = allrows.iloc[batch_size:].reset_index(drop=True)
                buf, n = [rest], len(rest)
        if n:
            yield apply(pd.concat(buf, ignore_index=True))

    return df.mapInPandas(run, StructType(kept + made.fields))


def filter_batches(df: DataFrame, fn: Callable[[pd.Series], pd.Series], col: str) -> DataFrame:
    """keep rows where a vectorised predicate on ``col`` is true."""
    pred = F.pandas_udf(fn, "boolean")
    return df.filter(pred(F.col(col)))


def lazy_transform(df: DataFrame, col: str, fn: Callable[[pd.Series], pd.Series], return_type: str,
                   name: str) -> DataFrame:
    """a column computed on access; nothing is stored (Spark plans are lazy)."""
    udf = F.pandas_udf(fn, return_type)
    return df.withColumn(name, udf(F.col(col)))


def hashed_embedding(df: DataFrame, id_col: str, text_col: str, dim: int = DEFAULT_DIM, keep: Sequence[str] = ()) -> DataFrame:
    """F6 default encoder: signed hashed token counts, L2-normalised; null for a text without direction.

    token -> md5 -> (bucket, sign) in the JVM; the tasks add up the codes of each row in
    its place, so nothing is shuffled and every text keeps its row.
    """
    def code(h):
        bucket = F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")
        return bucket * 2 + F.when(F.conv(F.substring(h, 9, 1), 16, 10).cast("int") < 8, 1).otherwise(0)

    def add_up(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            codes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.diff(lists.offsets.to_numpy())
            rows = np.repeat(np.arange(len(lists)), sizes)
            sums = np.bincount(rows * dim + codes // 2, codes % 2 * 2.0 - 1.0, len(lists) * dim).reshape(len(lists), dim)
            norms = np.sqrt((sums * sums).sum(axis=1))
            units = sums / np.where(norms > 0, norms, 1.0)[:, None]
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1) * dim, pa.int32()), pa.array(units.ravel()), mask=pa.array(norms == 0))

    tokens = df.select(id_col, *keep, F.transform(TX.tokens(text_col), lambda t: F.md5(t)).alias("h"))
    codes = tokens.select(id_col, *keep, F.transform("h", code).alias("codes"))
    return codes.select(id_col, *keep, F.arrow_udf(add_up, "array<double>")(F.col("codes")).alias("embedding"))


_PRETOKEN = None
# bound here so worker-side code carries the string, not the text module
_PATTERN = TX.PRETOKEN_PATTERN
_WS = "[\t\n\x0b\f\r \x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def numpy_hashed_encoder(texts: list[str], dim: int = DEFAULT_DIM) -> np.ndarray:
    """The default encoder as a Python function (used to exercise the user-encoder path)."""
    global _PRETOKEN
    if _PRETOKEN is None:
        import regex
        _PRETOKEN = regex.compile(_PATTERN), TX.unescaper()
    pattern, clean_text = _PRETOKEN
    out = np.zeros((len(texts), dim))
    for r, t in enumerate(texts):
        clean = re.sub(_WS, " ", clean_text(t or "")).strip(" ").lower()
        for tok in pattern.findall(clean):
            h = hashlib.md5(tok.encode("utf-8")).hexdigest()
            out[r, int(h[:8], 16) % dim] += 1.0 if int(h[8], 16) < 8 else -1.0
    norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(norms > 0, out / norms, np.nan)


def _worker_encoder(name: str, factory: Callable[[], Callable]) -> Callable:
    """The encoder of that name in this Python worker, built on first use.

    Shipped functions carry copies of their module's globals, so the cache hangs on ``sys``, which
    every task of a worker shares.
    """
    cache = vars(sys).setdefault("_pairloom_encoders", {})
    if name not in cache:
        cache[name] = factory()
    return cache[name]


def embed_corpus(df: DataFrame, id_col: str, text_col: str,
                 encoder_factory: Callable[[], Callable[[list[str]], np.ndarray]] | None = None,
                 dim: int = DEFAULT_DIM, encoder_name: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """a vector for every text of a corpus, null where the text gives none, next to the columns ``keep``.

    Without an encoder the hashed encoder runs. With ``encoder_factory`` the encoder is built once
    per Python worker, kept there under ``encoder_name`` (another name for another
    encoder), and applied to Arrow batches; null texts reach it as empty ones. Each task writes its own part.
    """
    if encoder_factory is None:
        return hashed_embedding(df, id_col, text_col, dim, keep)
    if encoder_name is None:
        raise ValueError("encoder_name: name the encoder, so that workers can keep it apart from others")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _worker_encoder(encoder_name, encoder_factory)
        for pdf in it:
            vecs = enc([t or "" for t in pdf[text_col].tolist()])
            yield pdf[[id_col, *keep]].assign(embedding=[None if np.isnan(v).any() else v.tolist() for v in vecs])

    passed = df.select(id_col, *keep)
    return df.select(id_col, *keep, text_col).mapInPandas(run, StructType([*passed.schema.fields, StructField("embedding", ArrayType(DoubleType()))]))


def _path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p)) and bool(fs.exists(jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")))


def _publish(spark: SparkSession, staged: str, path: str, replace: bool) -> None:
    """Give the complete folder ``staged`` the name ``path`` in one step, unless another writer did so before."""
    jvm = spark.sparkContext._jvm
    src, dst = (jvm.org.apache.hadoop.fs.Path(p) for p in (staged, path))
    fs = dst.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(dst) and (replace or not _path_exists(spark, path)):
        old = jvm.org.apache.hadoop.fs.Path(f"{staged}_old")
        fs.rename(dst, old)
        fs.delete(old, True)
    if not fs.exists(dst):
        fs.rename(src, dst)
    # the losing folder stands beside the table, or within it where both renamed at once: either is hidden from readers
    for loser in (src, jvm.org.apache.hadoop.fs.Path(dst, src.getName())):
        fs.delete(loser, True)


def materialize(make: Callable[[], DataFrame], spark: SparkSession, root: str, key: str, overwrite_cache: bool = False) -> DataFrame:
    """reuse a computed dataset stored under a fingerprint key unless ``overwrite_cache``.

    ``make`` builds the dataset and is called only when nothing is stored: a hit runs no job.
    The written table also cuts the lineage (a recomputation starts from it).

    The table is written to a folder of its own and renamed when complete, so that a reader never meets half of it and
    of two writers at once one table stays. A folder that an older job left without its success mark is replaced.
    """
    path = f"{root.rstrip('/')}/{key}"
    if overwrite_cache or not _path_exists(spark, path):
        staged = f"{root.rstrip('/')}/_staged-{uuid.uuid4().hex}"
        make().write.parquet(staged)
        _publish(spark, staged, path, overwrite_cache)
    return spark.read.parquet(path)
