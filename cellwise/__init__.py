"""cellwise: structured questions over tables, answered with the cells that were read, on PySpark."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run in workers travel with their code, so that executors need no installed copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
