"""Interval, image and graph analytics over labelled regions, expressed as Spark plans."""

import sys

from pyspark import cloudpickle

# functions sent to executors carry their code, so that executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
