"""Operators for preparing training text: duplicates, filters, secrets, mixing and shards."""

import sys

from pyspark import cloudpickle

# Tasks receive the helpers of this package by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
