"""Spark jobs that build and query lakes of annotated points and embeddings."""

import sys

from pyspark import cloudpickle

# Executors then need no installed copy: the small task helpers travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
