"""Spark-native analytics over typed interaction graphs: matched, scored negative pairs.

Functions that run inside Spark tasks are shipped by value, so executors don't need
this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
