"""Named queries over the fixture tables and their SQL oracles.

Each entry applies operators to a fixture stream. Doubles named in ``d`` are rounded to six places and integers named in
``i`` cast to BIGINT on both sides, as the engines add in different orders and widen differently.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Moves values that lie halfway between two roundings to one side, whatever the last bits are.
NUDGE = 1e-9
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def even(df: DataFrame) -> DataFrame:
    """Integers as BIGINT, doubles rounded."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        out.append(c.cast("bigint").alias(name) if kind in ("tinyint", "smallint", "int", "bigint") else F.round(c.cast("double") + NUDGE, 6).alias(name) if kind in ("double", "float") or kind.startswith("decimal") else c)
    return df.select(*out)


def query(name: str, sql: str | None = None, d: str = "", i: str = ""):
    def add(fn):
        _QUERIES[name] = lambda spark, sf_dir: even(fn(spark, sf_dir))
        if sql:
            parts = [f"round(CAST({c} AS DOUBLE) + {NUDGE}, 6) AS {c}" for c in d.split()] + [f"CAST({c} AS BIGINT) AS {c}" for c in i.split()]
            _ORACLES[name] = f"SELECT * REPLACE ({', '.join(parts)}) FROM ({sql})" if parts else sql
        return fn

    return add


def _load() -> None:
    from tidemark.plans import columns, decide, features, models, profiles, reports  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
