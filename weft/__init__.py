"""weft: web-corpus analytics on Spark.

Crawl data (pages, URLs, robots files, queue and job events) is processed as
DataFrames: URL canonicalisation, domain rules, HTML to documents, the link
graph, a depth-bounded frontier, page upserts, and crawl/queue statistics in
batch and with Structured Streaming.
"""

import sys

from pyspark import cloudpickle

from weft.session import get_spark, checkpoint_dir

# functions that run inside tasks are shipped with the job: executors need no copy of the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_spark", "checkpoint_dir"]
