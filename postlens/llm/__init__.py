"""Operators of a training-data pipeline; nothing else in the package imports them.

Functions that run in Python workers are pickled by value, so executors need
numpy, pyarrow and the named third-party libraries, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
