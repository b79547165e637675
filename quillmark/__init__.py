"""Spark-native document typing, field extraction and corpus preparation."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel with their code, so workers need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
