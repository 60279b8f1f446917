"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that make results reproducible and plans adaptive. They are only
# applied when the session is built here; a cluster session keeps its own.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


#: Bytes of rows that go to a Python worker at once (with Spark's limit of rows beside it): texts and vectors of any size
#: then take the same memory.
BATCH_BYTES = "8m"
DEFAULT_CONF["spark.sql.execution.arrow.maxBytesPerBatch"] = BATCH_BYTES


def get_spark(master: str = "local[8]", app: str = "pairloom",
              shuffle_partitions: int = 8, driver_memory: str = "16g",
              extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = driver_memory
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is. Only in local mode with nothing set (tests) do we pick a fresh private
    folder; on a cluster that would be a folder other machines cannot see, so it is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    local = tempfile.mkdtemp(prefix="pairloom-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def prepare_session(spark: SparkSession) -> None:
    """The checkpoint folder, and a limit on the bytes of Arrow batches where the session sets none."""
    ensure_checkpoint_dir(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def _scratch_root(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/pairloom-scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder for written tables."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def release_scratch(spark: SparkSession) -> bool:
    """Remove all tables that this application wrote for itself; True if there were any.

    Results are read lazily from them, so call it when a job's results are written. (The checkpoint
    folder has a name of its own for each application: nobody else's tables lie in it.)
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    return bool(root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))


def cut_lineage(df: DataFrame, name: str = "cut") -> DataFrame:
    """Compute ``df`` once into a parquet table in the shared folder and read it back.

    Later passes (counts, samples, joins) scan the stored rows instead of
    recomputing the plan, and a lost executor restarts from the table.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
