"""Research-measurement analytics on Spark: a publication graph, its indicators and its front-end tables."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few functions that run in Python workers travel by value, so executors need numpy and pandas but
# not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
