"""Operators for preparing text corpora. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
