"""Operators for preparing training text: search, filtering, deduplication, scoring, packing, archives."""

import sys

from pyspark import cloudpickle

# Functions run inside tasks travel whole, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
