"""Named queries over the driver tables and their oracle text."""
from __future__ import annotations

from aislemetry.plans.views import Views, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name, sql=None, extra=None):
    """Register `fn(views) -> DataFrame`; `sql` may use the views of `VIEW_SQL`."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql, extra)
        return fn
    return add
