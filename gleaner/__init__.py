"""Context retrieval, usage analytics and training-data operators on Spark.

Functions that run in Python workers travel with the tasks, so a cluster needs
no copy of this package on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
