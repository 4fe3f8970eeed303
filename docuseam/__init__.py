"""Document-corpus retrieval, evaluation and preparation as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel with the plan, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
