"""Operators that prepare large text and vector collections for training.

Functions that run in Python workers travel by value, so workers need not be
able to import this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
