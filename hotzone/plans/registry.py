"""All registered queries, imported once so each module adds its entries."""

from __future__ import annotations

from hotzone.plans import catalog
from hotzone.plans import q_features  # noqa: F401
from hotzone.plans import q_scoring  # noqa: F401
from hotzone.plans import q_spatial  # noqa: F401
from hotzone.plans import q_alerts  # noqa: F401
from hotzone.plans import q_forecast  # noqa: F401
from hotzone.plans import q_views  # noqa: F401
from hotzone.plans import q_stream  # noqa: F401

_MODULES = ["q_features"]


def _configured(fn):
    def run(spark, sf_dir):
        from hotzone.session import configure

        configure(spark)
        return fn(spark, sf_dir)

    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def queries():
    """Every registered query; each first applies the library's session settings."""
    return {name: _configured(fn) for name, fn in catalog.QUERIES.items()}


def oracle_sql():
    return catalog.SQL
