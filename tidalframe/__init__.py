"""tidalframe: Spark-native analytics over frames, signals, packets and text."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value: executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
