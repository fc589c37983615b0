"""weftline: Spark-native analytics over scripted text, containers and tables."""

from pyspark import cloudpickle as _cp
import sys as _sys

# Functions of this package travel to Python workers by value, so that the
# executors need no copy of the repository on their path.
_cp.register_pickle_by_value(_sys.modules[__name__])
