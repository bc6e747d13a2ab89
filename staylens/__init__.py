"""staylens: bookings analytics as Spark jobs."""

import sys as _sys

try:  # ship this package's functions inside the pickled tasks (no install on executors)
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle without the hook
    pass
