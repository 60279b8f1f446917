"""pairloom: caption-pair preparation, tokenisation and vector metrics as Spark DataFrame jobs."""

from __future__ import annotations

import sys

# Functions shipped to Python workers (pandas UDFs, applyInPandas kernels)
# carry this package's code with them, so executors need no installed copy.
try:
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover - older pyspark without the hook
    pass
