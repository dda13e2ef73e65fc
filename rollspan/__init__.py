"""Rolling-origin forecasting and evaluation of large series collections on Spark.

Every public operator takes DataFrames and returns a DataFrame.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# The few Arrow functions travel with the task, so workers need no installed copy.
register_pickle_by_value(sys.modules[__name__])
