"""Unanswered-traffic analytics on Spark DataFrames.

Packet tables or packet streams go in; unanswered packets, replied services,
service-rule lifetimes, host liveness, counters and reports come out.
"""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
