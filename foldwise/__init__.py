"""foldwise: classifier benchmarking and permutation-importance feature
selection as Spark jobs.

Functions of this package that run inside Spark tasks (pandas UDFs,
``mapInPandas`` bodies) are pickled by value, so executors need numpy and
pandas but not this package on their path.
"""

import sys

from pyspark import cloudpickle as _cp

_cp.register_pickle_by_value(sys.modules[__name__])
