"""Provenance graphs on Spark: claims and references as tables, read by declarative queries."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers are sent by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
