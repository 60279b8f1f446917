"""Embed newly arriving files with Structured Streaming.

The reference loops over part files one process at a time and skips files
already done. Here a file stream with a checkpoint does both: each trigger
picks up only files not yet committed, ``foreachBatch`` runs the batch
embedding job on them, and writes under a folder named by the batch id with
overwrite, so a retried batch replaces its own output (idempotent).
``trigger(availableNow=True)`` processes what is there and stops, so a
scheduled run is a catch-up run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as TX
from ..operators.udf import embed_corpus


def embed_new_files(spark: SparkSession, in_glob: str, out_dir: str, checkpoint: str,
                    schema: T.StructType, id_col: str, text_col: str,
                    max_files_per_trigger: int | None = None, encoder_factory: Callable | None = None,
                    encoder_name: str | None = None, files_per_name: int = 8) -> None:
    """Embed the files below ``in_glob`` that earlier runs have not, with the default or a user's encoder.

    Output: ``out_dir/batch=<trigger>/name=<input file without extension>``, one folder per input file.
    An input file's rows are dealt to ``files_per_name`` tasks, so a trigger writes neither tasks x names small files nor a
    large file from one task.
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.json(in_glob).select(id_col, text_col, TX.file_stem(F.col("_metadata.file_path")).alias("name"))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        emb = embed_corpus(batch, id_col, text_col, encoder_factory, encoder_name=encoder_name, keep=["name"])
        dealt = emb.repartition("name", F.pmod(F.xxhash64(id_col), F.lit(files_per_name)))
        dealt.write.mode("overwrite").partitionBy("name").parquet(f"{out_dir.rstrip('/')}/batch={batch_id}")

    q = (stream.writeStream.foreachBatch(per_batch)
               .option("checkpointLocation", checkpoint)
               .trigger(availableNow=True)
               .start())
    q.awaitTermination()


def read_embeddings(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.parquet(out_dir)
