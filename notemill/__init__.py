"""notemill: note-graph analytics on PySpark.

The package holds DataFrame operators over collections of markdown notes.  Sub-packages:

* ``functions``  column builders (keys, text extraction, vectors)
* ``sources``    readers: vault folders, parquet tables, configuration, change feeds
* ``operators``  whole-table operators (tags, links, graph, search, validation, ...)
* ``plans``      named queries over the test tables and their SQL counterparts
* ``streaming``  Structured Streaming jobs that keep the derived tables current
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# functions sent to Python workers travel whole, so executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
