"""vecsync: keep embedding columns in step with text columns, on Spark.

Every operator is a function over DataFrames / Columns.  Sub-packages:

* ``functions``  – Column -> Column expressions (cleaning, vectors, naming,
  error payloads, retry schedule).
* ``sources``    – table scans, change-feed parsing, side outputs.
* ``operators``  – DataFrame -> DataFrame steps (detect, route, embed,
  write back, monitor, catalog, tasks, k-NN).
* ``plans``      – end-to-end jobs built from the operators (backfill,
  completeness check, registration) and the query registry.
* ``streaming``  – Structured Streaming jobs over the same functions.
"""
import sys as _sys

try:  # ship this package by value inside pickled UDFs, so Python workers
    # never need it on their own path (cluster executors, other cwd).
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older pyspark
    pass

__version__ = "0.1.0"
