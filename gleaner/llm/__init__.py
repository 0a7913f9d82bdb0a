"""Operators for preparing training data. Nothing else in the library imports this."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so that no executor needs this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
