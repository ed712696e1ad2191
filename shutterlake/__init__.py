"""Spark-native analytics over media catalogues.

Task functions of this package are pickled by value, so executors need nothing but PySpark, numpy and pandas.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
