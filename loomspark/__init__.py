"""A Spark-native engine for graph memory, retrieval and analytics over DataFrames."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Python workers get the functions of this package by value, so executors need no copy of it.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
