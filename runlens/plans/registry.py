"""The table of queries."""

QUERIES = {}
SQL = {}


def query(sql: str = None):
    """Register a function (spark, sf_dir) -> DataFrame under its own name."""
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn
    return wrap
