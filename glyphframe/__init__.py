"""A string-analytics engine for Spark: composable Column and DataFrame verbs over Unicode text."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
