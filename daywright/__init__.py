"""Daily time-series features, budget allocation and rolling backtests on Spark.

Functions that run in Python workers are shipped whole, so executors need not have the package.
"""

import sys

from pyspark import cloudpickle

from daywright.settings import BaselineModel, ExtendedModel

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["BaselineModel", "ExtendedModel"]
__version__ = "0.1.0"
