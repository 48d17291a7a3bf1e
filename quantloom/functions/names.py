"""Names for helper columns."""

from __future__ import annotations


def fresh(name: str, taken) -> str:
    """A column name like ``name`` that isn't ``taken`` (in any case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name
