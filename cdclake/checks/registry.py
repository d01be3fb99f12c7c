"""All registered queries by name, and the SQL of those that SQL can express."""

from cdclake.checks.tables import Tables, with_tables

QUERIES, ORACLES = {}, {}


def query(name, sql=None, **common):
    """Register a function of `Tables` under a name, with its SQL over the shop tables."""
    def register(build):
        def run(spark, folder):
            return build(Tables(spark, folder))
        run.__doc__, run.__name__ = build.__doc__, name
        QUERIES[name] = run
        if sql:
            ORACLES[name] = with_tables(sql, common)
        return build
    return register


def load():
    from cdclake.checks import (  # noqa: F401
        expressions, incremental, lakehouse, layers, monitoring, relational)
    return QUERIES, ORACLES
