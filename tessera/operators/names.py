"""Names of columns that operators add for a while."""

from __future__ import annotations


def unused(taken: list[str], *names: str) -> list[str]:
    """The names, lengthened where a column of that name, in any case, is there already."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        name = f"_{name}"
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out
