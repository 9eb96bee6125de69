"""Queries over the operators, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from tessella.plans import alignment, annotation, documents, signals

QUERIES = {**signals.QUERIES, **annotation.QUERIES, **alignment.QUERIES, **documents.QUERIES}
ORACLE_SQL = {**signals.SQL, **annotation.SQL, **alignment.SQL, **documents.SQL}
