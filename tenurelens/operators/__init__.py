"""The engine's operators."""
import sys

from pyspark import cloudpickle

# Python workers need not have this package: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
