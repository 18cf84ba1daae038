"""tessera: representative-row selection and evaluation on Spark.

Sub-packages
------------
functions  column expressions (seeded hash order, vector maths) and scalar tails
sources    table scans and keyed stores (result files, curves, selections)
operators  DataFrame operators: preparation, selection, scoring, result tables, statistics
plans      end-to-end jobs composed from the operators (aggregation, analysis, experiment)
streaming  micro-batch forms of the restartable result sink
"""

__version__ = "0.1.0"

# Ship our functions to Python workers by value: executors then need no installed copy of
# this package (works the same on local[*] and on a cluster, whatever the working directory).
import sys as _sys  # noqa: E402

from pyspark import cloudpickle as _cloudpickle  # noqa: E402

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
