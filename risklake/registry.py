"""Maps operator ids to queries and to their SQL."""

from __future__ import annotations

from risklake.plans import analysers, analytics, corpus, flows, graphs, insights, relational

BOOKS = (relational.BOOK, analytics.BOOK, corpus.BOOK, graphs.BOOK, flows.BOOK, insights.BOOK, analysers.BOOK)


def queries() -> dict:
    return {name: query for book in BOOKS for name, query in book.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for book in BOOKS for name, sql in book.sql.items()}
