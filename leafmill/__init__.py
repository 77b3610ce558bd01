"""Analytics over large trees of text documents, written for Spark.

Every operator takes DataFrames and returns DataFrames.  Two table shapes occur
everywhere: ``files`` (path, content, size, mtime, ...) and ``nodes`` (path,
parent, name, kind, ...), the files together with their derived directories.
"""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to the executors by value, so a cluster needs no
# installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
