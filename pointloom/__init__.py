"""Point-table analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of the package travel to the workers by value: these need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
