"""docloom: a Spark-native engine for document analytics and ranked retrieval.

Operators are functions from DataFrames to DataFrames; nothing here starts a
session.  Functions that run in Python workers are shipped by value, so that
executors need the installed libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
