"""All registered queries of the engine itself."""

from __future__ import annotations

from quern.plans import function_queries, relational_queries, table_queries
from quern.session import configure

_MODULES = (relational_queries, function_queries, table_queries)


def queries() -> dict:
    found = {name: query for m in _MODULES for name, query in m.queries().items()}
    return {name: (lambda q: lambda spark, sf_dir: q(configure(spark), sf_dir))(query) for name, query in found.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.oracle_sql().items()}
