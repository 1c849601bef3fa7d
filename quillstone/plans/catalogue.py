"""The registered queries of the core and their SQL."""

from . import corpus, features, geometry, interventions, texts, vocabulary  # noqa: F401
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
