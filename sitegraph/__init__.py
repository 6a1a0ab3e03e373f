"""Captured web pages as Spark tables: URLs, link graph, text, changes, chunks and vector search."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers by value, so that executors need not have
# the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
