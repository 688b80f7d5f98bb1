"""Document retrieval and chat-event processing as Spark jobs.

``functions``  column expressions (text, JSON, vectors, chat events)
``operators``  DataFrame -> DataFrame steps
``sources``    readers and writers (documents, index, NDJSON, histories)
``streaming``  Structured Streaming forms of the operators
``plans``      whole jobs: index build, retrieval, chat responses, chat client
"""

import sys

from pyspark import cloudpickle

from sparrowline.session import prepare, work_path

__all__ = ["prepare", "work_path"]

# Functions that run in tasks travel with their code, so executors need not have
# this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
