"""threadsmith: curate forum threads into ordered stories on Spark.

Pages -> posts -> selected story posts -> rendered stories, with asset
reconciliation, a resumable per-topic cursor and run metrics.
"""

from .config import CurationConfig  # noqa: F401

__version__ = "0.1.0"


def _ship_code_by_value() -> None:
    """Python code of this package runs inside Spark tasks (the HTML parse,
    the normalisation UDF).  Pickling it by value sends the code with the
    task, so executors need no installed copy of the package (and the driver
    may start from any folder)."""
    import sys
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001 - older pickler: the package must be installed on executors
        pass


_ship_code_by_value()
