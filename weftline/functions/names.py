"""Names that don't collide, and names in other spellings."""

from __future__ import annotations

import re
from collections.abc import Collection


def free_name(name: str, taken: Collection[str]) -> str:
    """``name``, or the first of ``name_1``, ``name_2``, ... that isn't taken."""
    n, found = 0, name
    while found in taken:
        n += 1
        found = f"{name}_{n}"
    return found


def snake_case(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


def pascal_case(name: str) -> str:
    return "".join(part[:1].upper() + part[1:] for part in name.split("_"))


def escaped(name: str, mark: str = "_") -> str:
    """A name that may be followed by ``mark`` and a postfix: its own marks are doubled."""
    return name.replace(mark, mark * 2)


def unescaped(name: str, mark: str = "_") -> tuple[str, str | None]:
    """Name and postfix of an escaped name with or without one."""
    parts, i, cut = [], 0, None
    while i < len(name):
        if name.startswith(mark * 2, i):
            parts.append(mark)
            i += 2 * len(mark)
        elif name.startswith(mark, i):
            cut = i
            break
        else:
            parts.append(name[i])
            i += 1
    return "".join(parts), None if cut is None else name[cut + len(mark) :]
