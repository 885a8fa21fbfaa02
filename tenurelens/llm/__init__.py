"""Training-data operators: quality, secrets, WARC, sharding, deduplication,
packing, mixing and language identification.  Nothing outside this subpackage
imports it except ``__spark_entry__`` and ``corpus_pipeline``."""
import sys

from pyspark import cloudpickle

# Python workers need not have this package: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
