"""Where queries and their oracles are kept by name."""

from __future__ import annotations

from tallyfold.plans.canonical import Canonical
from tallyfold.plans.oracles import over

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register f(canonical) under a name, with its oracle over the canonical tables."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Canonical(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = over(sql)
        return f

    return add
