"""docloom: a PySpark-native engine that turns documents into a hybrid search index and training data."""

import sys

from pyspark import cloudpickle

# Python workers get our functions by value, so a cluster needs no copy of this package on its nodes.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
