"""Evidence retrieval over scientific text, as Spark plans."""

import sys

from pyspark import cloudpickle

# Executors needn't have this package: what runs there is sent along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
