"""Sinks: prepared tables, embeddings, rows with vectors, metrics, text, files."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX


def write_prepared(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Save a prepared (tokenised) dataset for later runs."""
    df.write.mode(mode).parquet(path)


def write_embeddings(df: DataFrame, path: str, id_col: str, vec_col: str, file_col: str | None = None,
                     mode: str = "overwrite", files_per_name: int = 8) -> None:
    """(id, embedding) only, one output folder per input file.

    The output name is the input file name without its last 5 characters (the length of
    '.json'). A name's rows are dealt to ``files_per_name`` tasks, so there are neither tasks x names
    small files nor one task for a hot name.
    """
    if not file_col:
        df.select(id_col, vec_col).write.mode(mode).parquet(path)
        return
    named = df.select(id_col, vec_col, TX.cut_chars(TX.file_name(file_col), 5).alias("name"))
    dealt = named.repartition("name", F.pmod(F.xxhash64(id_col), F.lit(files_per_name)))
    dealt.write.mode(mode).partitionBy("name").parquet(path)


def write_rows_with_vectors(rows: DataFrame, vecs: DataFrame, path: str, id_col: str, mode: str = "overwrite") -> None:
    """Original rows plus their vector columns as JSON lines; a row without a vector keeps its place, without the vector."""
    rows.join(vecs, id_col, "left").write.mode(mode).json(path)


def write_metrics(metrics: DataFrame, path: str, run: str, split: str, fmt: str = "json") -> None:
    """(run, split, name, value) rows; names prefixed by the split unless already.

    A run's split has a folder of its own below ``path``, so a retried run replaces its rows instead of
    repeating them; readers of ``path`` get run and split back as columns.
    """
    name = F.when(F.col("name").startswith(f"{split}_"), F.col("name")).otherwise(
        F.concat(F.lit(f"{split}_"), F.col("name")))
    folder = "/".join(f"{k}={quote(v, safe='')}" for k, v in (("run", run), ("split", split)))
    metrics.select(name.alias("name"), "value").write.mode("overwrite").format(fmt).save(f"{path.rstrip('/')}/{folder}")


def write_text(df: DataFrame, col: str, path: str, mode: str = "overwrite", line_end: str | None = None) -> None:
    """One stripped value per line.

    A line end inside a value would make two lines of it: it becomes ``line_end``, or is an error without one.
    """
    value = TX.strip(F.col(col))
    inner = value.rlike(r"[\r\n]")
    fixed = F.regexp_replace(value, r"\r\n|[\r\n]", line_end) if line_end is not None else F.raise_error(F.lit("a value holds a line end")).cast("string")
    df.select(F.when(inner, fixed).otherwise(value).alias("value")).write.mode(mode).text(path)


def _fs_uri(df: DataFrame, path: str) -> str:
    """``path`` as Spark's default file system resolves it, as a URI that pyarrow accepts on every executor."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = str(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString())
    return "file://" + uri[len("file:"):] if uri.startswith("file:") and not uri.startswith("file://") else uri


def write_files(df: DataFrame, out_dir: str, name_col: str, content_col: str) -> DataFrame:
    """Write one file per row from the executors (binary content), through pyarrow's file systems.

    Returns (name, path, bytes) for the files written. Used to lay down
    file-per-item inputs such as images.
    """
    base = _fs_uri(df, out_dir.rstrip("/"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as pafs
        filesystem, root = pafs.FileSystem.from_uri(base)
        filesystem.create_dir(root, recursive=True)
        for pdf in it:
            paths, sizes = [], []
            for name, content in zip(pdf[name_col], pdf[content_col]):
                p = f"{root}/{name}"
                parent = p.rsplit("/", 1)[0]
                filesystem.create_dir(parent, recursive=True)
                data = bytes(content)
                with filesystem.open_output_stream(p) as f:
                    f.write(data)
                paths.append(p)
                sizes.append(len(data))
            yield pd.DataFrame({"name": pdf[name_col], "path": paths, "bytes": sizes})

    return df.select(F.col(name_col), F.col(content_col)).mapInPandas(run, "name string, path string, bytes long")
