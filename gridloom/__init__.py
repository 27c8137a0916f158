"""Document-grid analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run inside Python workers travel with the plan, so executors
# need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
