"""Cross-market price comparison as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Python workers get the few helper functions by value, so executors need not
# have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
