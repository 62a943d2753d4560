"""Aviation-notice analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from noticewing.session import build_session

# Executors get the few Python helpers by value, so nothing has to be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session"]
