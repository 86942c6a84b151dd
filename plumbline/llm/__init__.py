"""Operators for building language-model training data; nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# task code travels with the job, so executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
