"""Batch analytics over imaging-instrument runs, written as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so the package
# has to be installed on the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
