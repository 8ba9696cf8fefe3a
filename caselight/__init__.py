"""Drug-safety signal work as Spark jobs.

``sources``    fixed-width extracts, tables in and out
``functions``  special functions and seeded hashing as columns
``operators``  DataFrame -> DataFrame building blocks
``plans``      whole jobs: load, score, enrich, train and judge
"""

import sys

from pyspark import cloudpickle

# Functions that run inside Python workers travel with the job, so executors
# need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
