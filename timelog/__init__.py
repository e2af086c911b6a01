"""Spark-native analytics for timestamp-triggered event logs.

Functions defined in this package are pickled by value, so jobs that ship
Python code run on executors that do not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
