"""Operators for training-data corpora: near and exact duplicates, toxicity, secrets, archives, tokens, packing, chat.

Nothing else in the library imports this subpackage. Functions that run inside tasks are shipped by value, so
executors need the installed libraries but not this folder.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
