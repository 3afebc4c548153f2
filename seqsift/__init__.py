"""Similarity search over keyed sequences of feature vectors, on Spark DataFrames.

Functions that run on executors are pickled by value, so workers need not have this package installed.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
