"""tidemark: a PySpark-native analytics library for financial time series and record clean-up.

Every operator is a DataFrame-in, DataFrame-out function. Most only declare their plan; those that read a table several
times or need counts first write tables or run jobs when they are called, as their docstrings say.
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run in Python workers travel with the job, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
