"""Document layout analytics on Spark: layout to markdown, checks, ingest, scoring."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel whole, so executors need no copy
# of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
