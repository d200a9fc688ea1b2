"""Spark-native analytics for multi-channel recordings and interval annotations."""

import sys

from pyspark import cloudpickle

# ship the code of Python kernels with each job, so executors need no installation
cloudpickle.register_pickle_by_value(sys.modules[__name__])
