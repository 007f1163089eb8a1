"""Pairs each Spark query with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession

from closetlake.plans import settings
from verification.views import TABLES, VIEWS, standalone_sql

AS_OF = date(1998, 6, 30)
NOW = datetime(2024, 1, 30, 12, 0, 0)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}

_NAME = re.compile(r"\{(\w+)\}")


class Tables:
    """Attribute access to the driver's tables and to the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._cache:
            if name in TABLES:
                frame = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in VIEWS:
                frame = self.sql(VIEWS[name])
            else:
                raise AttributeError(name)
            self._cache[name] = frame
        return self._cache[name]

    def sql(self, text: str) -> DataFrame:
        """Run a text in Spark; ``{name}`` stands for a table or view."""
        used = {n: getattr(self, n) for n in set(_NAME.findall(text)) if n in TABLES or n in VIEWS}
        return self.spark.sql(text, **used)


def query(name: str, covers: str, oracle: str | None = None):
    """Register a query under ``name`` for the inventory rows in ``covers``."""

    def wrap(build: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, name

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Tables(settings.apply(spark), sf_dir))

        run.__doc__ = build.__doc__
        run.__name__ = name
        QUERIES[name] = run
        COVERS[name] = covers
        if oracle is not None:
            ORACLES[name] = standalone_sql(oracle)
        return build

    return wrap
