"""railyard: rail-ticketing analytics expressed as Spark DataFrame plans.

Subpackages
-----------
sources    domain-table readers, the test-data adapter, report catalogue, JSON ingest, sinks
plans      the ticket report mart and its date windows
operators  lookups, data-quality rules, write-path transforms, job-status batch jobs
functions  column-expression helpers (enum order, reference codes, durations)
streaming  the job-status change feed on Structured Streaming
"""

import sys

from pyspark import cloudpickle

from railyard.session import get_session

# functions of this package travel to Python workers by value: executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_session"]
