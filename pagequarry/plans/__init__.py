"""Every registered query of the library outside the numbered operators."""

from pagequarry.plans import documents, linked, reading, relational, structured

QUERIES = relational.QUERIES | documents.QUERIES | structured.QUERIES | linked.QUERIES | reading.QUERIES
ORACLE_SQL = relational.ORACLE_SQL | documents.ORACLE_SQL | structured.ORACLE_SQL | linked.ORACLE_SQL | reading.ORACLE_SQL
