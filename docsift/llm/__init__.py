"""Operators for preparing training text: filters, deduplication, mixing, decontamination, token counts.

Nothing outside this package imports it. Functions that run inside Python workers are sent with their code, so that
executors need no installed copy of the library.
"""

import docsift
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(docsift)
