"""Spark-native analytics for time-sectioned text corpora."""

import sys

from pyspark import cloudpickle

# Functions of this package go to executors whole, so these need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
