"""cataloom: organise very large file collections with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# The few Python helpers travel with the job, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from cataloom.plans.organise import Organised, organise, organise_folder  # noqa: E402

__all__ = ["Organised", "organise", "organise_folder"]
