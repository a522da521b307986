"""All registered queries and, where SQL expresses them, their SQL."""

from __future__ import annotations

from chunkloom.plans import browse, graph, relations, search

FLAGSHIP = "layered_search"

QUERIES = search.QUERIES | graph.QUERIES | browse.QUERIES | relations.QUERIES

SQL = search.SQL | graph.SQL | browse.SQL | relations.SQL
