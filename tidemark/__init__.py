"""Survey and sensor analytics for replicated field experiments, as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# The few vectorised Python functions travel inside the job, so that workers need no copy of the
# package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
