"""Log threat detection on Spark DataFrames: many files, one job."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few functions that run in Python workers travel inside their tasks, so
# executors need pyspark and pyarrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
