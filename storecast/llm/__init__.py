"""Operators for preparing training text at scale, one module each.

Nothing else in the library imports this subpackage. Every operator selects
the columns it needs by name, so extra columns (whatever their names) are
ignored, and returns a lazy DataFrame keyed by the integer id of its input.
"""

import sys

from pyspark import cloudpickle

# Tasks get the code by value, so executors need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
