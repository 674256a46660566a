"""Cohort studies on event-level longitudinal data, as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Ship the few small helpers that run inside tasks with the task itself, so
# executors need no separate installation of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
