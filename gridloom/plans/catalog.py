"""Registry of the queries over the driver's tables, and their SQL where SQL can express them."""

from . import geometry_queries, grid_queries, model_queries, state_queries, table_queries, text_queries

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for part in (text_queries, grid_queries, geometry_queries, model_queries, state_queries, table_queries):
    QUERIES |= part.QUERIES
    ORACLE_SQL |= part.ORACLE_SQL
