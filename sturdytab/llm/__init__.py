"""Training-data operators. Nothing else in the library imports this subpackage.

Task code is pickled by value, so executors need no copy of the library on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
