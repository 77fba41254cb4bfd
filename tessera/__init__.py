"""tessera: data-quality measurement, monitoring and documentation on Spark.

Every public operator is a plain function ``DataFrame(s) -> DataFrame`` built from
``pyspark.sql.functions`` so Catalyst sees (and optimizes) the whole plan.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Python functions sent to workers (mapInPandas completers, foreachBatch helpers) are
    pickled by value, so workers need no installed copy of this package; on a cluster the
    package can still be shipped with --py-files or a wheel."""
    try:
        import sys

        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # older cloudpickle: rely on the package being installed
        pass


_ship_by_value()
