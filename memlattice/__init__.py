"""Spark-native analytics for agent-memory tables: retrieval, graphs, versions, beliefs and streams."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with what they use, so the workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
