"""Automated tabular analytics on Spark DataFrames.

Load a table, work out what its columns mean, validate and profile it, clean
it, turn it into features, train and rank models, and emit the chart series
and facts that describe the result.  Every operator takes a DataFrame and
returns a DataFrame; Spark plans, partitions and shuffles all of the work.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Helpers that run inside tasks travel with the job, so executors need no copy
# of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
