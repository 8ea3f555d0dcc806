"""Operators for preparing language-model training data. Nothing outside this folder imports it."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: the functions that tasks run travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
