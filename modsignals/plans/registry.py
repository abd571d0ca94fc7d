"""All registered queries and their SQL twins."""

from . import oracle, queries, stored, stored_oracle

QUERIES = queries.QUERIES | stored.QUERIES
ORACLE_SQL = oracle.ORACLE_SQL | stored_oracle.ORACLE_SQL
