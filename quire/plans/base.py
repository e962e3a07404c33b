"""The registry itself, and the short forms in which queries are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.sources import views
from quire.sources.views import sql, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return put


def on(view: str, name: str, body: str | None, make: Callable[[DataFrame], DataFrame], more: str = "") -> None:
    """A query of one view (or table); body: its SQL after the view's definition."""
    source = getattr(views, view, None) if view in views.ALL else None
    run = lambda s, d: make(source(s, d) if source else table(s, d, view))
    oracle = None if body is None else sql(f"{view} {more}".strip(), body) if source else body
    query(name, oracle)(run)


def cols(title: str, view: str, key: str, make: Callable[[], dict], sqls: dict[str, str]) -> None:
    """A query of column functions on a view: its key plus each name with its column (made when the query runs) and SQL."""
    keys = key.split()
    body = f"SELECT {', '.join(keys)}, " + ", ".join(f"{s} AS {n}" for n, s in sqls.items()) + f" FROM {view}"
    on(view, title, body, lambda df: df.select(*keys, *[c.alias(n) for n, c in make().items()]))
