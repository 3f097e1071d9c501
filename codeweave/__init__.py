"""codeweave: preparing, retrieving over and evaluating text-to-code data
sets with Spark DataFrames.

* ``codeweave.sources``   -- task records, corpora, token blocks, caches,
  similarity dumps, catalogs and snapshots.
* ``codeweave.functions`` -- column expressions for text, code and skeletons.
* ``codeweave.operators`` -- DataFrame operators: retrieval, schema-item
  pruning, prompts, packing, candidates, snapshots, metrics.
* ``codeweave.plans``     -- end-to-end flows and the driver's query registry.
* ``codeweave.streaming`` -- the row-wise operators on a file stream.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python kernels travel to the executors by value, so a job started outside the
# source folder needs no copy of the package on the workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
