"""Trellium: supervised learning on tables, expressed as Spark jobs.

``sources``    scans and writes (CSV, Parquet, JSON messages, registry, versions)
``functions``  column expressions
``operators``  DataFrame in, DataFrame out
``streaming``  the same operators behind ``readStream`` / ``foreachBatch``
``plans``      whole jobs (train, predict) and the registered queries
"""

__version__ = "0.1.0"
