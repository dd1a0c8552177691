"""Spark-first analytics over benchmark runs, configurations and text corpora."""

from pyspark import cloudpickle as _cloudpickle

# Functions of this package travel to executors by value, so that a worker needs no copy of the package on its path.
_cloudpickle.register_pickle_by_value(__import__(__name__))
