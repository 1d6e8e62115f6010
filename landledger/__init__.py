"""Parcel compliance and result audit, expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Executors need no installed copy: the few Python functions travel with their jobs.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
