"""All queries over the engine's operators and the SQL that gives the same rows."""

from __future__ import annotations

from tessera.plans import counts, expression, files, genomic, grounding

MODULES = (genomic, files, counts, expression, grounding)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
