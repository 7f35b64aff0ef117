"""echofold: repeat-pass change measurement as Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Tasks receive the package's functions by value, so the workers of a cluster
# need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
