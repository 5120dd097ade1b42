"""Operators over text corpora and vectors, built for training-data pipelines.

Nothing else in the library imports this package.  Functions that run inside tasks travel by
value, so that executors need numpy and pyarrow but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
