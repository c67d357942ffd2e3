"""Operators for building training corpora: one module per operator, registered in ``queries``.

Functions take DataFrames and return DataFrames. Python that runs in executors is pickled by value,
so the workers need numpy, pyarrow and the like, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
