"""All registered queries of the web-archive engine and their SQL."""

from __future__ import annotations

from .plans import captures, reports, states, stored
from .plans import queries as plans

MODULES = (plans, reports, states, stored, captures)


def queries():
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
