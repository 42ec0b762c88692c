"""A PySpark-native engine for versioned key-value tables."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that these need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
