"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from taktline.checks.oracle_views import compose
from taktline.checks.links_views import LinksViews as Views
from taktline.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, needs: str = "", sql: str | None = None):
    """Register a function of the derived views under ``name``.

    ``sql`` gives the same rows in ANSI SQL, on the views listed in ``needs``.
    """

    def register(build: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Views(tune(spark), sf_dir))

        run.__name__ = name
        run.__doc__ = build.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = compose(needs, sql) if needs else sql.strip()
        return build

    return register
