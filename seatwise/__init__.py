"""Spark-native prediction of a hidden categorical assignment from its own history."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
