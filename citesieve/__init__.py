"""Screening of citation tables and evidence extraction from document tables, on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package that run in Python workers travel with the job, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
