"""Spark-native analytics operators: spend anomalies, credit risk, text, geo, imaging, timelines."""

import sys

from pyspark import cloudpickle

from tallywise.session import tune

# The few functions that run in Python workers travel with the job: no worker has to install the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["tune"]
