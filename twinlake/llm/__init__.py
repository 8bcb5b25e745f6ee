"""Operators for preparing language-model training data; nothing else in the library imports this subpackage."""

from .registry import ORACLE_SQL, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
