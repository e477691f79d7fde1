"""Churn and retention analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions of the library travel to the Python workers by value, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
