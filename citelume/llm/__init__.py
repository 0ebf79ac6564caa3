"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Executors needn't have this package: what runs there is sent along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
