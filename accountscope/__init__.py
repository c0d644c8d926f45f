"""accountscope: account profiling over large text collections, written as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions handed to Arrow batches travel by value: executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
