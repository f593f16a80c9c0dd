"""stonegraph: a PySpark-native engine for corpora of scholarly text editions.

Python functions that run on executors are pickled by value, so a cluster
needs this package on the driver only.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
