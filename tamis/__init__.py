"""Message classification and text features as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel with their code, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
