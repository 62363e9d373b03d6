"""flowscope: analysis of recorded user-interface sessions, expressed as Spark plans.

Functions that run in Python workers are shipped by value, so a cluster needs no
installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
