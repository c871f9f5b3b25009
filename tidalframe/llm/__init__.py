"""Operators that a training-data pipeline needs; nothing else imports this."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: they need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
