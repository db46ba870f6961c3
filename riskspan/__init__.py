"""Time-series risk, code triage and training-data operators on Spark."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: functions that tasks run travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
