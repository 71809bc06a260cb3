"""loomseq: a Spark-native engine for short-read sequence data."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Executors need no installed copy: functions of this package travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
