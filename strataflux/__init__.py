"""Strataflux: numeric conformance, pixel, media-stream, run and audio analytics on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors need no copy of this package: the few pandas functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
