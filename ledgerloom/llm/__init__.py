"""Operators for preparing language-model training data, one module each."""

import sys

from pyspark import cloudpickle

# Tasks get this package's functions with the plan, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
