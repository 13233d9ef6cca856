"""lexiloom: corpus engineering and model evaluation as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
