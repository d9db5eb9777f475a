"""Registered queries over the given tables and their SQL."""

from . import assessment, bursts, evaluation, learning, runs, texts  # noqa: F401  (register their queries)
from .tables import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
