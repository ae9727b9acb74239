"""Operators for cleaning text corpora: one module each, registered in ``workload``."""

import sys

from pyspark import cloudpickle

# Tasks get this package's functions with the job: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
