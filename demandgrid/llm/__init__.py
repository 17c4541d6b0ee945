"""Operators of a training-data pipeline over documents and embeddings."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: functions sent to them carry its code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
