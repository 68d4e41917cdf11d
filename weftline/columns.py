"""Column roles and the names that carry them."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Prefixes of hidden columns.
META = "__"
SOURCE = "_source_"
SYSTEM_TAG = "_tag::"
CONTEXT = "_context_key"
CONTENT_HASH = "_content_hash"


def source_column(packet: str) -> str:
    return SOURCE + packet


@dataclass(frozen=True)
class Roles:
    """Names by role, in order. Each packet column has one source column."""

    tags: tuple[str, ...]
    packets: tuple[str, ...]
    system_tags: tuple[str, ...] = ()
    meta: tuple[str, ...] = ()

    @property
    def sources(self) -> tuple[str, ...]:
        return tuple(map(source_column, self.packets))

    @property
    def columns(self) -> tuple[str, ...]:
        return (*self.tags, *self.system_tags, *self.packets, *self.sources, *self.meta)

    def renamed(self, names: dict[str, str]) -> "Roles":
        new = lambda cs: tuple(names.get(c, c) for c in cs)
        return replace(self, tags=new(self.tags), packets=new(self.packets), system_tags=new(self.system_tags))


def q(name: str) -> str:
    """A name as one quoted identifier."""
    return "`" + name.replace("`", "``") + "`"
