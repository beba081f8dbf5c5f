"""lakeloom: a Spark-native engine for document lakes.

Functions of this package that reach executors are shipped by value, so a
cluster needs no copy of it on its machines.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
