"""All registered queries of the library and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}
_MODULES = ("recode", "reshape_joins", "aggregates", "windows_sets", "estimates", "regressions", "pairs_compare", "checks")


def query(name: str, sql: str | None = None, d: str = "", i: str = ""):
    """Register a query. Columns in ``d`` are rounded to six digits, columns in ``i`` are cast to whole numbers, on both sides."""
    doubles, wholes = d.split(), i.split()

    def add(f: Callable) -> Callable:
        def run(spark, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            fixed = {c: F.when(~F.isnan(F.col(c).cast("double")), F.round(F.col(c).cast("double"), 6) + F.lit(0.0)) for c in doubles}
            return df.withColumns(fixed | {c: F.col(c).cast("long") for c in wholes})

        _QUERIES[name] = run
        if sql is not None:
            parts = [f"CASE WHEN isnan(CAST({c} AS DOUBLE)) THEN NULL ELSE round(CAST({c} AS DOUBLE), 6) + 0.0 END AS {c}" for c in doubles] + [f"CAST({c} AS BIGINT) AS {c}" for c in wholes]
            _SQL[name] = f"SELECT * REPLACE ({', '.join(parts)}) FROM ({sql}) AS result" if parts else sql
        return f

    return add


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"rankloom.plans.{m}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
