"""Train, score and evaluate multiclass classifiers over Spark tables of feature vectors."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry this package's code with them, so workers
# need numpy and pyarrow only and nothing has to be installed or shipped first.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
