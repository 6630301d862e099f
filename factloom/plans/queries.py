"""Registry of the core queries."""

from __future__ import annotations

from . import corpus, extras, fits, formats, hygiene, kb, matrix, measures

MODULES = (matrix, corpus, kb, measures, fits, extras, formats, hygiene)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
