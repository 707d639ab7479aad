"""Every registered query of the engine and its equivalent SQL."""

from importlib import import_module

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _name in ("search", "ingest", "evidence", "evaluation", "reads", "jobs", "stores"):
    _module = import_module(f"{__package__}.{_name}")
    QUERIES |= _module.Q
    ORACLE_SQL |= _module.SQL
