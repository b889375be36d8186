"""Analytics over facility measurements, satellite pixels and gridded weather, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Tasks carry this package's functions with them, so that executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
