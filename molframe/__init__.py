"""Molecular descriptor analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Workers get this package's functions by value, so it need not be installed on every executor.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
