"""Training-data operators: sharding, quality, fixity, decontamination, language, near-duplicates,
secrets, repeated passages, fingerprints and source mixing.

Nothing outside this folder (and corpus_pipeline.py) imports it. The functions that Spark sends to
Python workers travel by value, so the workers need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
