"""Connectivity analytics for circuit-board records, and training-data operators, on PySpark."""

import sys

from pyspark import cloudpickle

# Tasks get this package's functions with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
