"""All queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from songframe.plans import charts, joins, measures, sequences, signals, texts

PARTS = (sequences, measures, joins, texts, charts, signals)
QUERIES = {name: f for part in PARTS for name, f in part.Q.queries.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.Q.sql.items()}
