"""chronoscope: Spark-native preparation of labelled time series and evaluation of
attribution methods (relevance, top-k / bottom-k corruption sweeps, summary metrics).

Data model (long form, one row per cell):
    cells      (noun_id, feature, t, x)
    targets    (noun_id, target)
    relevance  (method, noun_id, feature, t, r)
All randomness is md5-seeded per key so results do not depend on partitioning.
"""

import sys

from pyspark import cloudpickle

from chronoscope.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "checkpoint_dir"]

# functions that Spark sends to Python workers travel by value: the workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
