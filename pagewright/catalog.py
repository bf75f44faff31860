"""All queries over the reference tables and their SQL, by name."""

from __future__ import annotations

from .plans import build, curate, evaluate, files

QUERIES = {**evaluate.QUERIES, **curate.QUERIES, **build.QUERIES, **files.QUERIES}
ORACLE_SQL = {**evaluate.ORACLE_SQL, **curate.ORACLE_SQL, **build.ORACLE_SQL, **files.ORACLE_SQL}
