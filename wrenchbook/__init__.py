"""wrenchbook: Spark jobs for multi-tenant work-order data.

Sub-packages: ``functions`` (column helpers), ``sources`` (readers and sinks),
``operators`` (DataFrame to DataFrame functions), ``plans`` (bindings of the
test tables and the query registry) and ``streaming`` (stateful streams).
"""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so that they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
