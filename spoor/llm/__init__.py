"""Operators of a training-data pipeline; nothing else in the package imports this.

Functions that run in tasks are sent to the executors by value, so this package need not be
installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
