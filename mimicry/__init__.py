"""Brand-lookalike analytics as Spark DataFrame jobs.

``sources`` reads and writes the tables, ``functions`` holds column expressions,
``operators`` the DataFrame-to-DataFrame building blocks, ``plans`` the user-level
jobs made of them, and ``streaming`` the same jobs over unbounded input.
"""

import sys

from pyspark import cloudpickle

# Arrow UDFs travel with the query, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
