import sys

from pyspark import cloudpickle

# Lets Python workers run the stand-in generators without this folder on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
