"""Column names that do not clash with those of the input."""

from __future__ import annotations

from collections.abc import Iterable


def fresh(columns: Iterable[str], *wanted: str) -> tuple[str, ...]:
    """``wanted`` with underscores added until no name (letter case aside) is one of ``columns``."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)
