"""Spark-native preparation, checking and evaluation of two-speaker dialogue data."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Kernels travel to executors by value, so a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
