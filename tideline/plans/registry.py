"""All registered queries of the library, by name, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "sensor_fingerprint"
MODULES = ("kernels", "profiles", "grids", "signals", "health", "relations", "drift", "corpus", "reports", "privacy", "streams", "files", "threads", "faults", "reviews", "catalog", "analysis")

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}
_where: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that results of engines that add in another order compare."""
    return df.select(*[(F.round(f.name, digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields])


def query(name: str, sql: str | None = None, doubles: str = "") -> Callable[[Query], Query]:
    """Registers a query; ``doubles`` names the columns of ``sql`` that are rounded like the query's own."""

    def register(make: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(make(spark, sf_dir))

        run.__doc__ = make.__doc__
        _queries[name], _where[name] = run, make.__module__.rpartition(".")[2]
        if sql:
            replaced = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in doubles.split())
            _oracles[name] = f"SELECT * REPLACE ({replaced}) FROM ({sql})" if replaced else sql
        return make

    return register


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"tideline.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)
