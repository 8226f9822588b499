"""Curation and evaluation of labelled text as lazy PySpark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Python helpers inside Arrow UDFs travel with the task, so executors need
# no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
