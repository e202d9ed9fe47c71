"""Operators for preparing training data; nothing else in the library imports this subpackage.

Each module holds one operator with its general interface. ``catalog`` registers the queries.
"""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the workers by value, so they need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
