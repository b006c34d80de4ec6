"""srclens: source-corpus analytics expressed as Spark DataFrame jobs.

Layout
------
sources    corpus listing and reading, snapshots, JSON and vector-document sinks,
           and a Java corpus rendered from plain tables
functions  column helpers (text, JSON, rounding, counting)
operators  declaration extraction, statistics, lookups, prompts, chunks, vectors
plans      the registered queries and the SQL they are checked against
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python tasks travel with the job, so that executors need not
# have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
