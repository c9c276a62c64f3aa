"""Capture analytics on Spark: signal files and ordered series as tables."""

import sys

from pyspark import cloudpickle

# Send the functions of this package to the workers by value: executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
