"""Registered queries: each a use of the library on the given tables, beside equivalent SQL."""

from . import loads, questions, texts

QUERIES = questions.QUERIES | texts.QUERIES | loads.QUERIES
ORACLE_SQL = questions.ORACLE_SQL | texts.ORACLE_SQL | loads.ORACLE_SQL
