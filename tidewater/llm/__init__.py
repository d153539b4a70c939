"""Operators for preparing language-model training data.

Every operator takes DataFrames and gives a DataFrame; the query modules
(`queries`) only fix parameters and derive the digest columns of the results.
Nothing outside this folder and `corpus_pipeline.py` imports it.
"""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so that executors need
# no copy of this package on their own disks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
