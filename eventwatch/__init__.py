"""Security-event analytics on Spark: normalise, detect, correlate, triage, report."""

import sys

from pyspark import cloudpickle

# Ship this package's functions inside the tasks, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
