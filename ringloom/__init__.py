"""Seeded content assignment and batch compositing on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the task, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
