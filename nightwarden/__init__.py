"""nightwarden: security analytics expressed as Spark DataFrame and streaming jobs."""

import sys

from pyspark import cloudpickle

# Executors receive the small Arrow helpers with the job, the package need not be there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
