"""Operators for large training-data pipelines over tables of documents.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Functions for the Python workers travel with the plan, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
