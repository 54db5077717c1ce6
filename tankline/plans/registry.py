"""Every registered query and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from tankline.plans.tables import load, twin

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, tables: str, sql: str | None = None, sql_tables: str | None = None):
    """Register a function of the named tables' DataFrames, and the SQL of its result."""

    def keep(make):
        names = tables.split()
        QUERIES[name] = lambda spark, sf_dir: make(*load(spark, sf_dir, *names))
        if sql is not None:
            model = [n for n in (sql_tables if sql_tables is not None else tables).split()]
            ORACLES[name] = twin(sql, *[n for n in model if n in _model()])
        return make

    return keep


def _model():
    from tankline.plans.tables import TABLES

    return TABLES


from tankline.plans import actuals, audit, files, fleet, planning, scalars, streams  # noqa: E402,F401  these register themselves
