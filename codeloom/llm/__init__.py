"""Operators of a training-data pipeline. Functions that run inside tasks travel with the job."""

import sys

from pyspark import cloudpickle

# executors need numpy and pyarrow, but not this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
