"""Spatial analytics on DataFrames of points; coordinates are plain double columns."""

import sys

from pyspark import cloudpickle

# Functions that go to executors carry this package's code with them; nothing need be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
