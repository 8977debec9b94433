"""Spark-first analytics engine for visual search and training-data pipelines."""

import sys

from pyspark import cloudpickle

# Functions go to executors with their code, so the package needn't be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
