"""Spark-native estimation of purchase price ceilings from executed contracts."""

import sys

from pyspark import cloudpickle

# The few Python functions travel to the workers by value, so that the package needs no
# installation there and the workers run the code the driver has.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
