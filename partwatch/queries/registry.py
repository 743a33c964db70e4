"""Where queries and their oracle statements are registered."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.skew import running_totals
from .fixtures import Fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}
# The engine behind the statements gives null, not 0, when a count_if has no true row.
COUNT_IF = re.compile(r"count_if\(((?:[^()]|\([^()]*\))*)\)")


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql.strip()


def _needed(sql: str, done: list[str], open_: tuple[str, ...] = ()) -> None:
    """Views a statement reads, dependencies first. A recursive view also names itself."""
    for name in re.findall(r"\bv_\w+", sql):
        if name in VIEWS and name not in done and name not in open_:
            _needed(VIEWS[name], done, (*open_, name))
            done.append(name)


def with_views(sql: str) -> str:
    names: list[str] = []
    _needed(sql, names)
    if not names:
        return sql
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names) + "\n" + sql.strip()


def placed(df, keys: list[str], order: list):
    """Rows with ``n``, their place in an order: row sets alone would not show it."""
    return running_totals(df, keys, order, {"n": F.lit(1).cast("bigint")})


def query(name: str, oracle: str | None = None):
    """Register ``fn(Fixtures) -> DataFrame`` under ``name``."""

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Fixtures(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = COUNT_IF.sub(r"count(*) FILTER (WHERE \1)", with_views(oracle))
        return fn

    return register
