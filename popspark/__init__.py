"""popspark: population-genetic, graph and statistical analysis on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel whole, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
