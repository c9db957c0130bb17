"""revlens: review analytics as Spark DataFrame operators.

Every public function takes and returns ``pyspark.sql.DataFrame`` (or a
``Column`` for scalar functions) and stays lazy, so callers compose whole
plans and let Catalyst/AQE choose the physical strategy.
"""

__version__ = "0.1.0"

# Python functions that run on executors (page extraction, batch scoring, test
# p-values) are shipped by value, so workers need no installed copy of this
# package: neither a cluster image nor a driver started outside the repository.
try:
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: ship with --py-files instead
    pass
