"""Operators for building training corpora. Nothing else in the library imports this package.

Functions that run in Python workers are sent to them with their code, so executors need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
