"""A PySpark-native analytics and retrieval engine.

Everything is expressed over DataFrames; see README.md for the map of modules.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# worker functions travel by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
