"""Each operator turns frames into a frame of lazy DataFrame steps and knows its identity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..columns import Roles, q, source_column
from ..errors import InputValidationError
from ..frame import TagFrame, ordered_index
from ..functions.hashing import hash_object
from ..functions.typing import fits
from ..plans.tracking import record


class Operator:
    """Call it on frames; calls are recorded by the pipeline that is open."""

    ordered = True  # whether the order of inputs matters to identity
    symmetric = False

    def __init__(self, label: str | None = None):
        self.label = label or type(self).__name__

    def arguments(self) -> tuple:
        return ()

    def apply(self, *frames: TagFrame) -> TagFrame:
        raise NotImplementedError

    def identity(self, frames) -> str:
        lineage = [f.lineage for f in frames]
        return hash_object([type(self).__name__, list(map(str, self.arguments())), sorted(lineage) if self.symmetric else lineage]).to_hex()

    def __call__(self, *frames: TagFrame) -> TagFrame:
        out = self.apply(*frames).derived(self.identity(frames))
        return record(self, frames, out)


def _types(frame: TagFrame, names) -> dict:
    return {n: frame.df.schema[n].dataType for n in names}


class Join(Operator):
    """Natural inner join on shared tags; a Cartesian product without any."""

    symmetric = True

    def apply(self, *frames):
        if not frames:
            raise InputValidationError("join needs an input")
        return frames[0] if len(frames) == 1 else reduce(self.two, map(self.stamped, frames))

    @staticmethod
    def stamped(frame: TagFrame) -> TagFrame:
        """System tags carry the lineage of the input they come through."""
        return frame.renamed({c: f"{c}:{frame.lineage[:12]}" for c in frame.roles.system_tags})

    @staticmethod
    def two(left: TagFrame, right: TagFrame) -> TagFrame:
        l, r = left.roles, right.roles
        if both := set(l.packets) & set(r.packets):
            raise InputValidationError(f"packet columns on both sides: {sorted(both)}")
        if mixed := set(l.tags) & set(r.packets) | set(l.packets) & set(r.tags):
            raise InputValidationError(f"tags on one side, packets on the other: {sorted(mixed)}")
        shared = [t for t in l.tags if t in r.tags]
        a, b = _types(left, shared), _types(right, shared)
        if odd := [t for t in shared if a[t] != b[t] and not fits(a[t], b[t]) and not fits(b[t], a[t])]:
            raise InputValidationError(f"tags of different types: {odd}")
        # integers (and floats) of different widths are one type: the wider one
        wide = {t: F.col(q(t)).cast(b[t] if fits(a[t], b[t]) else a[t]) for t in shared if a[t] != b[t]}
        ldf, rdf = (f.df.withColumns(wide) if wide else f.df for f in (left, right))
        twice = [c for c in r.system_tags if c in l.system_tags]
        new = {c: f"{c}:r" for c in twice}
        rdf = rdf.withColumnsRenamed(new)
        df = ldf.join(rdf, shared, "inner") if shared else ldf.crossJoin(rdf)
        roles = Roles((*l.tags, *(t for t in r.tags if t not in shared)), (*l.packets, *r.packets), (*l.system_tags, *(new.get(c, c) for c in r.system_tags)))
        return TagFrame(df.select(*map(q, roles.columns)), roles, left.lineage)


class SemiJoin(Operator):
    """Left rows with a match on all common tag and packet columns."""

    def apply(self, left, right):
        names = lambda f: (*f.roles.tags, *f.roles.packets)
        common = [c for c in names(left) if c in names(right)]
        if not common:
            return left
        a, b = _types(left, common), _types(right, common)
        if odd := [c for c in common if a[c] != b[c]]:
            raise InputValidationError(f"columns of different types: {odd}")
        return left.having(left.df.join(right.df.select(*map(q, common)), common, "left_semi").select(*map(q, left.df.columns)))


class _Columns(Operator):
    kind, keep = "tags", True

    def __init__(self, columns, strict: bool = True, label=None):
        super().__init__(label)
        self.columns, self.strict = tuple([columns] if isinstance(columns, str) else columns), strict

    def arguments(self):
        return (self.columns, self.strict)

    def apply(self, frame):
        own = getattr(frame.roles, self.kind)
        if self.strict and (missing := [c for c in self.columns if c not in own]):
            raise InputValidationError(f"no such {self.kind}: {missing}")
        kept = tuple(c for c in own if (c in self.columns) == self.keep)
        if kept == own:
            return frame
        return frame.selected(**{self.kind: kept})


class SelectTagColumns(_Columns):
    kind, keep = "tags", True


class DropTagColumns(_Columns):
    kind, keep = "tags", False


class SelectPacketColumns(_Columns):
    kind, keep = "packets", True


class DropPacketColumns(_Columns):
    kind, keep = "packets", False


class _Map(Operator):
    kind = "tags"

    def __init__(self, name_map: dict[str, str], drop_unmapped: bool = False, label=None):
        super().__init__(label)
        self.name_map, self.drop_unmapped = dict(name_map), drop_unmapped

    def arguments(self):
        return (sorted(self.name_map.items()), self.drop_unmapped)

    def apply(self, frame):
        own = getattr(frame.roles, self.kind)
        names = {a: b for a, b in self.name_map.items() if a in own}
        if not names:  # nothing to rename: the data stays, unmapped columns too
            return frame
        kept = tuple(c for c in own if c in names or not self.drop_unmapped)
        other = frame.roles.packets if self.kind == "tags" else frame.roles.tags
        result = [names.get(c, c) for c in kept]
        if len(set(result)) < len(result) or set(result) & set(other):
            raise InputValidationError(f"renamed columns collide: {sorted(result)}")
        out = frame.selected(**{self.kind: kept})
        if self.kind == "packets":
            names |= {source_column(a): source_column(b) for a, b in names.items()}
        return out.renamed(names)


class MapTags(_Map):
    kind = "tags"


class MapPackets(_Map):
    kind = "packets"


class Filter(Operator):
    """All predicates (columns, SQL text, booleans) and equalities; null drops the row."""

    def __init__(self, predicates=(), constraints: dict | None = None, label=None):
        super().__init__(label)
        single = isinstance(predicates, (str, bool, Column))
        self.predicates = [predicates] if single else [p for x in predicates for p in ([x] if isinstance(x, (str, bool, Column)) else x)]
        self.constraints = dict(constraints or {})

    def arguments(self):
        return (self.predicates, sorted(self.constraints.items()))

    def apply(self, frame):
        tests = [F.expr(p) if isinstance(p, str) else F.lit(p) if isinstance(p, bool) else p for p in self.predicates]
        tests += [F.col(q(c)) == F.lit(v) for c, v in self.constraints.items()]
        return frame.having(frame.df.where(reduce(Column.__and__, tests))) if tests else frame


class Batch(Operator):
    """Consecutive rows in tag order become one row of lists (nulls kept)."""

    def __init__(self, batch_size: int = 0, drop_partial_batch: bool = False, label=None):
        super().__init__(label)
        if batch_size < 0:
            raise ValueError("a batch size below 0")
        self.batch_size, self.drop_partial_batch = batch_size, drop_partial_batch

    def arguments(self):
        return (self.batch_size, self.drop_partial_batch)

    def apply(self, frame):
        columns = frame.df.columns
        if self.batch_size:
            indexed = ordered_index(frame.df, (*frame.roles.tags, *frame.roles.system_tags), "__i")
            group = F.floor(F.col("__i") / self.batch_size)
        else:  # one batch: the order key alone sorts it
            indexed = frame.df.withColumn("__i", F.struct(*(F.struct(F.col(q(c)).isNull(), F.col(q(c))) for c in (*frame.roles.tags, *frame.roles.system_tags))))
            group = F.lit(0)
        rows = F.sort_array(F.collect_list(F.struct("__i", F.struct(*map(q, columns)).alias("__r"))))
        out = indexed.groupBy(group.alias("__g")).agg(rows.alias("__x"))
        if self.batch_size and self.drop_partial_batch:
            out = out.where(F.size("__x") == self.batch_size)
        lists = [F.col("__x")["__r"][c].alias(c) for c in columns]
        return TagFrame(out.select(*lists), frame.roles, frame.lineage)


