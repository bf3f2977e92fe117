"""All registered queries and their SQL, from the query modules of this folder."""

from __future__ import annotations

from . import combining, differential, driver, models, networks, shaping

MODULES = (differential, shaping, combining, networks, models, driver)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
