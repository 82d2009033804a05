"""loomspark — DataFrame-in / DataFrame-out data-operations jobs on Apache Spark.

Sub-packages:
  sources    readers for landed files, stores, workbooks and the stand-in views
  functions  column expressions (names, durations, formats, type maps, SQL text)
  operators  the jobs: run analytics, reconcile, schema audit, compare, lineage, catalog
  plans      read-only SQL entry point and the registered query catalogue
  streaming  incremental ingest and a watermarked health roll-up
"""
import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the executors by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
