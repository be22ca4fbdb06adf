"""Every operator as a named query over the supplied tables, with equivalent SQL where there is one."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers f(spark, sf_dir) under a name."""

    def keep(f):
        if name in QUERIES:
            raise ValueError(f"{name!r} is taken")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def load():
    from strandline.catalog import aggregates, ledgers, series, shapes, sinks, sources, streams  # noqa: F401

    return QUERIES, ORACLES
