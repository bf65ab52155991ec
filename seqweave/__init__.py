"""Sequence analytics on PySpark: ordered, time-coded text as DataFrames."""

import sys

from pyspark import cloudpickle

# executors get the functions they run by value, so that the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
