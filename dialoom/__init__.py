"""Spark-native engine for two-speaker dialogues: transcripts, tick events, frame streams, batches."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers are sent by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
