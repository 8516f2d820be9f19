"""All queries of the library's own operators, and their SQL."""

from lorehive.queries import catalogue_queries, ingest_queries, search_queries, stream_queries  # noqa: F401
from lorehive.queries.base import QUERIES, SQL
from lorehive.queries.search_queries import entry


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)


__all__ = ["entry", "oracle_sql", "queries"]
