"""Corpus analytics on Spark: text ETL, ranked lexical and vector search, alignment and chat history."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so executors need no copy
# of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
