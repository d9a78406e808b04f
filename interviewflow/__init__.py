"""Spark jobs for text experiments over interview transcripts.

Every operator takes and returns DataFrames (or Columns), so Catalyst sees the
whole plan. Where a job must look at data while a plan is built (headers,
longest cells, sizes and repeats of keys), the function says so. Sub-packages:

* ``sources``    readers and writers
* ``functions``  Column expressions
* ``operators``  DataFrame -> DataFrame operators
* ``plans``      the composed jobs a user starts from
* ``streaming``  incremental prompt processing
"""

import sys

from pyspark import cloudpickle

# Generator and tokenizer code is sent to Python workers by value, so the
# package need not be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
