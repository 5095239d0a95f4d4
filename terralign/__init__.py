"""Spark-native analytics for geotagged image surveys."""

import sys

from pyspark import cloudpickle

# Functions for executors travel with the job, so that a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
