"""All registered queries and their SQL, gathered from the family modules."""

from __future__ import annotations

from . import curating, records, relational, search, texts, transcription, vectors

FAMILIES = (search, relational, texts, vectors, records, transcription, curating)

QUERIES: dict = {k: f for m in FAMILIES for k, f in m.query.queries.items()}
ORACLE_SQL: dict[str, str] = {k: s for m in FAMILIES for k, s in m.query.sql.items()}
