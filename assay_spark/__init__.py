"""assay_spark: feature-table preparation, exact repeatable sampling, vector
feature expansion, grouped model evaluation and score roll-ups on Spark.

Every operator is a DataFrame -> DataFrame function.  Cell keys
(``act, rec, sub, version, split``) are ordinary columns, so loops over
subsamples and sizes in a single-machine workflow become group-by and join
keys here and run as one Spark job.
"""

import sys as _sys

# Python workers receive this package's functions (user kernels, UDF bodies)
# by value, so they run even where the package is not importable on the
# executors; a cluster deployment can still ship it with --py-files.
try:
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 -- older pyspark: fall back to by-reference
    pass

from assay_spark.session import get_spark, checkpoint_dir  # noqa: E402

__all__ = ["get_spark", "checkpoint_dir"]
