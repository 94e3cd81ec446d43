"""A versioned key-value engine whose every operation is a DataFrame query over rows (key, value, seq, tombstone)."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: its functions travel with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
