"""Plumbline: model and data audits expressed as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Ship the small Python helpers with the tasks, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
