"""Gentle-slope cycling data and training-corpus jobs on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
