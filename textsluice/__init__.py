"""Text screening on Spark: detect, redact, judge, limit, gate, audit, replay."""

import sys

from pyspark import cloudpickle

# Functions of this package that run in Python workers are shipped with the
# job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
