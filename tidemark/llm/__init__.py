"""Corpus operators for training data; nothing else in the library imports this subpackage.

Functions that run in Python workers are shipped with the plan, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
