"""Operators of a training-data pipeline: extraction, sharding, tokens, near
duplicates, licences, vector search, packing, WARC, quality and toxicity.

Nothing outside this package imports it.  Its modules are pickled by value,
so Python workers need only the third-party packages, not this repository on
their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
