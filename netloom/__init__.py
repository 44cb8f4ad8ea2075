"""netloom: network-flow analytics as plain Spark DataFrame functions."""

import sys

from pyspark import cloudpickle

# The few Python helpers travel to the tasks by value, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
