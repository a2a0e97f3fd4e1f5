"""Detection-data analytics as Spark DataFrame operators.

Sub-packages: ``functions`` (column expressions and dimensions), ``operators``
(DataFrame to DataFrame), ``sources`` (readers, writers, contract check),
``streaming`` (stateful twins of the event operators) and ``plans`` (views over
tables and the registered queries).
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel inside the job, so Python workers need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
