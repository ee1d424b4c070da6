"""Seasonal analytics on Spark: many keyed monthly series, one DataFrame API.

Every operator takes and returns DataFrames and is keyed by one or more series
columns, so the single-series case is simply the one-key case.
"""

import sys

from pyspark import cloudpickle

from tidemark.session import build_session, shared_dir

# The few Python functions travel to the executors with their code, so that the package
# need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "shared_dir"]
