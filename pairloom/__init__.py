"""pairloom: a Spark-native engine for parallel text corpora.

Corpus curation, exact deterministic splits and samples, batch text
rewriting and distributed text-quality scoring, all written as DataFrame
plans.  Public functions take and return DataFrames; nothing that grows
with the data is collected to the driver.
"""

import sys

__version__ = "0.1.0"

# Python tasks (the content-score UDF, map_text) carry pairloom's code with
# them, so executors need no installed copy of the package.
try:
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: ship with addPyFile instead
    pass
