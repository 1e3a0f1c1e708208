"""Registered queries and their SQL."""

from parley.plans import archive, records, scale, talk

QUERIES = {**talk.QUERIES, **archive.QUERIES, **records.QUERIES, **scale.QUERIES}
ORACLE_SQL = {**talk.ORACLE_SQL, **archive.ORACLE_SQL, **records.ORACLE_SQL, **scale.ORACLE_SQL}
