"""A note-corpus search engine on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package go to the executors by value, so that it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
