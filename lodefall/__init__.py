"""A PySpark-native engine for searching and analysing document archives."""

from lodefall.session import session, table

__all__ = ["session", "table"]
