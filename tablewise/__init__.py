"""Spark-native understanding, loading and querying of large collections of messy tables."""

import sys

from pyspark import cloudpickle

# Python tasks carry their code along, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
