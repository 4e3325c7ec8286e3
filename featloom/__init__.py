"""featloom: feature and embedding tables on Spark.

Sub-packages
------------
sources     CSV, JDBC, media manifests, corpus routing
sinks       long feature tables, wide embedding files, CSV and JDBC export
functions   Column expressions: vectors, text, statistics
operators   DataFrame -> DataFrame operators
plans       end-to-end jobs composed from the above
streaming   which operators also accept a streaming DataFrame
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel with the tasks that run them, so it need not
# be installed on the workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
