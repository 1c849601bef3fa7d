"""Where queries register themselves, with the SQL that must give the same rows."""

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        name = f.__name__.rstrip("_")  # a trailing underscore keeps clear of an operator's name
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add
