"""framewright: Spark-native analytics over per-frame detections and the records around them.

Functions that run in Python workers are shipped by value, so executors need not have the package installed.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
