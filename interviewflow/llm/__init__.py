"""Operators for training-data pipelines over tables of documents, conversations and benchmarks.

Nothing else in the library imports this package. Each operator is a function
from DataFrame to DataFrame; ``queries`` applies them to whole tables.
"""

import sys

from pyspark import cloudpickle

# Functions run by Python workers travel with the plan; the workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
