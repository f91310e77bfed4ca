"""Shared folders for intermediate tables, and names for helper columns."""

from __future__ import annotations

from ..storage import drop, new_folder, shared_root, written

__all__ = ["drop", "fresh", "new_folder", "shared_root", "written"]


def fresh(taken: list[str], *names: str) -> list[str]:
    """Each name with underscores behind it until no column in ``taken`` bears it, in any case."""
    used = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out
