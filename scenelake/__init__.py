"""Media-catalog search and enrichment expressed as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Python tasks carry the code they need, so executors work without this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
