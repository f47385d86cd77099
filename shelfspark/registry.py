"""Where queries over the catalog's views and the SQL each must equal are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.views import Catalog, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, make: Callable[[Catalog], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(Catalog(spark, sf_dir))
    if sql:
        ORACLES[name] = oracle(sql)


def shared_sql(c: Catalog, sql: str) -> DataFrame:
    """``sql``, in words that Spark and DuckDB share, over the views it names."""
    import re

    from .sources.views import BASE, VIEWS

    used = {}
    for t in (*BASE, *VIEWS):
        sql, n = re.subn(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
        if n:
            used[t] = getattr(c, t)
    return c.spark.sql(sql, **used)


def rounded(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)
