"""Identify, value and rank inventory detections with Spark DataFrames.

Every operator is a function from DataFrames to a DataFrame.  Nothing is kept
between calls; thresholds, price basis and seeds are plain arguments.
"""

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
