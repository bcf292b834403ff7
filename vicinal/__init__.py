"""Retrieval-based classification of wide numeric tables, expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from vicinal.config import RunConfig

# Functions that run in tasks travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["RunConfig"]
