"""Labelled-array ("data cube") analytics on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Workers get functions of the package by value, so that executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
