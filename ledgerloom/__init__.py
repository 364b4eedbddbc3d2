"""Retail and revenue analytics as Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

# Functions for Python workers travel by value: workers need not import this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
