"""Collects queries by name."""

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    """Register a ``(spark, sf_dir) -> DataFrame`` function under ``name``."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add
