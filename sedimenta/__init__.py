"""Spark-native analytics for counts tables, sequences, vectors and self-organising maps."""

import sys

from pyspark import cloudpickle

# functions of this package travel with their tasks, so that workers need not have it on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
