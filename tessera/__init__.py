"""A PySpark-native engine for document corpora: catalog, chunks, ranked search, facts."""

import sys

from pyspark import cloudpickle

# Executors get the package's functions by value, so they need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules["tessera"])
