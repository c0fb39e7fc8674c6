"""lurewatch: phishing-data analytics as Spark DataFrame jobs.

* ``functions``  column builders (URL, host, text, maths) - no shuffle
* ``operators``  DataFrame -> DataFrame building blocks (joins, metrics,
  windows, sampling, retrieval, scan history)
* ``plans``      the composed jobs (feature tables, verdicts, data sets,
  retrieval, model training)
* ``sources``    readers and writers
* ``streaming``  jobs that also run on ``readStream`` input
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so the package
# does not have to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
