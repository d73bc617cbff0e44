"""kilnset: training-data preparation as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Helper functions travel to the executors with the jobs that use them, so
# the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
