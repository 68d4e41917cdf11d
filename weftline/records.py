"""One row with its roles: what a frame does to all rows, done to one on the driver."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field, replace

import pyarrow as pa

from .columns import META, source_column
from .functions.hashing import ContentHash, hash_object


@dataclass(frozen=True)
class Record(Mapping):
    """Tags, packet and hidden values. As a mapping it has its tags and packet.

    Records are values: every change gives another one. Two records with the
    same data have one content hash, whatever their meta values and context.
    """

    tags: dict
    packet: dict
    sources: dict = field(default_factory=dict)
    system_tags: dict = field(default_factory=dict)
    meta: dict = field(default_factory=dict)
    context: str | None = None

    @property
    def data(self) -> dict:
        return {**self.tags, **self.packet}

    def __getitem__(self, name):
        return self.data[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.data)

    def __len__(self) -> int:
        return len(self.data)

    def _known(self, names, error=KeyError) -> None:
        if missing := [n for n in names if n not in self.data]:
            raise error(f"no such columns: {missing}")

    def _only(self, keep) -> "Record":
        some = lambda d: {k: v for k, v in d.items() if keep(k)}
        return replace(self, tags=some(self.tags), packet=some(self.packet), sources=some(self.sources))

    def select(self, *names: str) -> "Record":
        self._known(names, ValueError)
        return self._only(set(names).__contains__)

    def drop(self, *names: str, ignore_missing: bool = False) -> "Record":
        if not ignore_missing:
            self._known(names)
        return self._only(lambda k: k not in names)

    def rename(self, names: Mapping[str, str]) -> "Record":
        """The source info of a packet value follows its name."""
        new = lambda d: {names.get(k, k): v for k, v in d.items()}
        out = replace(self, tags=new(self.tags), packet=new(self.packet), sources=new(self.sources))
        if len(out) < len(self):
            raise ValueError(f"renamed columns collide: {sorted(names.values())}")
        return out

    def update(self, **values) -> "Record":
        self._known(values)
        new = lambda d: {k: values.get(k, v) for k, v in d.items()}
        return replace(self, tags=new(self.tags), packet=new(self.packet))

    def with_columns(self, **values) -> "Record":
        if twice := [n for n in values if n in self.data]:
            raise ValueError(f"columns exist: {twice}")
        return replace(self, packet={**self.packet, **values}, sources={**self.sources, **dict.fromkeys(values)})

    def with_source_info(self, **info) -> "Record":
        return replace(self, sources={k: info.get(k, v) for k, v in self.sources.items()})

    def with_meta(self, **values) -> "Record":
        return replace(self, meta={**self.meta, **{_meta(k): v for k, v in values.items()}})

    def drop_meta(self, *names: str, ignore_missing: bool = False) -> "Record":
        gone = set(map(_meta, names))
        if not ignore_missing and (missing := gone - set(self.meta)):
            raise KeyError(f"no such meta values: {sorted(missing)}")
        return replace(self, meta={k: v for k, v in self.meta.items() if k not in gone})

    def get_meta(self, name: str, default=None):
        return self.meta.get(_meta(name), default)

    def with_context(self, key: str | None) -> "Record":
        return replace(self, context=key)

    def copy(self) -> "Record":
        return replace(self, **{k: dict(getattr(self, k)) for k in ("tags", "packet", "sources", "system_tags", "meta")})

    def as_dict(self, system_tags=False, sources=False, meta=False, context: str | None = None) -> dict:
        out = {**self.tags, **(self.system_tags if system_tags else {}), **self.packet}
        if sources:
            out |= {source_column(k): v for k, v in self.sources.items()}
        return out | (self.meta if meta else {}) | ({context: self.context} if context else {})

    def as_table(self, schema: pa.Schema | None = None, **flags) -> pa.Table:
        return pa.Table.from_pylist([self.as_dict(**flags)], schema=schema)

    def types(self) -> dict[str, type]:
        return {k: type(v) for k, v in self.data.items()}

    def content_hash(self) -> ContentHash:
        return hash_object(self.data)

    def __hash__(self) -> int:
        return self.content_hash().to_int()


def _meta(name: str) -> str:
    return name if name.startswith(META) else META + name
