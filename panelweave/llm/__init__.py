"""Operators of a training-data pipeline over ``documents``, ``embeddings``, ``pages`` and ``labels``.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it. Its functions travel to the
workers by value, so a cluster needs no copy of the package.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
