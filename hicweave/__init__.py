"""Spark-native Hi-C scaffolding analytics: joins, aggregates and windows over contact tables."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value: nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
