"""Size-checked broadcast.

A side is broadcast only after its row count (and, with a width, its byte
estimate) is measured below a limit. Above the limit the plain join is kept;
AQE may still turn it into a broadcast from runtime statistics, or split
skewed partitions (``spark.sql.adaptive.skewJoin.enabled``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_ROWS = 1_000_000
DEFAULT_MAX_BYTES = 256 * 1024 * 1024


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS,
                       row_bytes: int | None = None,
                       max_bytes: int = DEFAULT_MAX_BYTES) -> tuple[DataFrame, int]:
    """Return ``(df or broadcast(df), rows)`` after counting ``df``."""
    n = int(df.count())
    small = n <= max_rows and (row_bytes is None or n * row_bytes <= max_bytes)
    return (F.broadcast(df) if small else df), n
