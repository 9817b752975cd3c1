"""Operators for large training corpora.

Nothing outside this subpackage imports it, so it can be removed whole.
Functions that run inside Spark tasks are shipped by value: executors need
numpy, pyarrow and xxhash, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
