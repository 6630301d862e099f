"""Names of helper columns that can't clash with a caller's."""

from __future__ import annotations


def free(columns: list[str], *wanted: str) -> tuple[str, ...]:
    """Each wanted name, with underscores behind it until no column (whatever its case) has it."""
    taken = {c.lower() for c in columns}
    out = []
    for w in wanted:
        while w.lower() in taken:
            w += "_"
        taken.add(w.lower())
        out.append(w)
    return tuple(out)
