"""All registered queries of the library and the SQL that checks them."""

from __future__ import annotations

from . import code_queries, hub_queries, note_queries, page_queries, vault_queries

QUERIES: dict = page_queries.QUERIES | note_queries.QUERIES | code_queries.QUERIES | vault_queries.QUERIES | hub_queries.QUERIES
ORACLE_SQL: dict[str, str] = page_queries.ORACLE_SQL | note_queries.ORACLE_SQL | code_queries.ORACLE_SQL | vault_queries.ORACLE_SQL | hub_queries.ORACLE_SQL
