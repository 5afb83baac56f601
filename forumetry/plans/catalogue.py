"""Every query of the library, with the SQL that checks it. The two sides share only the tables' adapters and the configured sides."""

from __future__ import annotations

from forumetry.plans import details, discussion, languages, pagetext, runs, scalars, sources, trees

QUERIES: dict = details.QUERIES | discussion.QUERIES | languages.QUERIES | runs.QUERIES | scalars.QUERIES | pagetext.QUERIES | sources.QUERIES | trees.QUERIES
ORACLE_SQL: dict[str, str] = details.ORACLE_SQL | discussion.ORACLE_SQL | languages.ORACLE_SQL | runs.ORACLE_SQL | scalars.ORACLE_SQL | pagetext.ORACLE_SQL | sources.ORACLE_SQL | trees.ORACLE_SQL
