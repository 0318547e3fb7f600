"""Operators of a training-data pipeline over raw text, vectors and web pages.

Nothing else in the library imports this package. Every operator takes and
returns DataFrames; what it decides depends on the rows and their ids only.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
