"""Paired-imagery analytics and training-data operators on Spark."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors with their code, so that the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
