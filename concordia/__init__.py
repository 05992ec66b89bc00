"""concordia: list reconciliation (diff, resolve, change sets, enrichment) on Spark."""

import sys as _sys

# The Arrow helpers are defined in this package; ship them to the Python
# workers by value so executors need no copy of the package on their path.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: package must be on the workers' path
    pass
