"""pairlake: a PySpark engine for preference data (prompts, answers, verdicts, pairs)."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package go to the executors by value, so that only the driver needs it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
