"""xmcforge: extreme multi-label classification data engine on Spark."""

import sys as _sys

# Functions that run in Python workers (Arrow/pandas block scorers, encoders, streaming state)
# are defined in this package.  Shipping them by value means executors need no installed copy
# of the package: cloudpickle serializes their code instead of an import reference.
try:  # pragma: no cover - depends on the PySpark build
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # older cloudpickle: rely on the package being importable on executors
    pass
