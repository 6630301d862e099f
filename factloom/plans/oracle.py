"""DuckDB SQL of the core queries."""

from __future__ import annotations

from .queries import MODULES

ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
