"""A lazy DataFrame whose columns have roles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from html import escape
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .columns import CONTENT_HASH, CONTEXT, META, SYSTEM_TAG, Roles, q, source_column
from .errors import InputValidationError
from .functions.hashing import hash_object, row_hash, schema_hash

if TYPE_CHECKING:
    from .records import Record


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def ordered_index(df: DataFrame, order, name: str) -> DataFrame:
    """Rows numbered from 0 by ``order`` (nulls last), other columns breaking ties.

    Rows are range-partitioned and written once with their partition number; a
    row's index is its place in the partition plus the rows of those before. No
    task holds more than a partition.
    """
    from .plans.files import written

    keys = [F.col(q(c)).asc_nulls_last() for c in order]
    keys += [F.col(q(f.name)).asc_nulls_last() for f in df.schema if f.name not in order and f.dataType.typeName() not in ("map", "variant")]
    placed = written(df.repartitionByRange(*keys).withColumn("__p", F.spark_partition_id()) if keys else df.withColumn("__p", F.lit(0)), "ordered")
    w = Window.partitionBy("__p").orderBy(*keys) if keys else Window.partitionBy("__p").orderBy("__p")
    counts = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(F.broadcast(before.select("__p", "__b")), "__p").withColumn(name, F.row_number().over(w) - 1 + F.col("__b")).drop("__p", "__b")


@dataclass(frozen=True, eq=False)
class TagFrame:
    """Tags key a row, packets are its payload; provenance columns are hidden.

    A frame without a name (``lineage``) is known by its plan: equal plans are one input.
    Meta columns (``__name``) go along with rows but through neither joins nor pods.
    """

    df: DataFrame
    roles: Roles
    lineage: str
    version: object = None
    context: str | None = None

    @classmethod
    def of(cls, df: DataFrame, tags=(), system_tags=(), source_info: dict | None = None, lineage: str | None = None) -> "TagFrame":
        tags = tuple([tags] if isinstance(tags, str) else tags)
        if missing := [t for t in (*tags, *system_tags) if t not in df.columns]:
            raise InputValidationError(f"no such columns: {missing}")
        marks = {c: c if c.startswith(SYSTEM_TAG) else SYSTEM_TAG + c for c in system_tags} | {c: c for c in df.columns if c.startswith(SYSTEM_TAG)}
        packets = tuple(c for c in df.columns if c not in tags and c not in marks and not c.startswith("_"))
        if not packets:
            raise InputValidationError("a stream needs a packet column")
        roles = Roles(tags, packets, tuple(marks.values()))
        info = source_info or {}
        sources = [(F.lit(info[p]) if p in info else F.col(q(source_column(p))) if source_column(p) in df.columns else F.lit(None)).cast("string").alias(source_column(p)) for p in packets]
        out = df.select(*map(q, tags), *(F.col(q(c)).alias(s) for c, s in marks.items()), *map(q, packets), *sources)
        return cls(out, roles, lineage or hash_object(["frame", schema_hash(df), list(tags), df.semanticHash()]).to_hex())

    # --- building blocks of operators

    def having(self, df: DataFrame) -> "TagFrame":
        return replace(self, df=df)

    def derived(self, lineage: str) -> "TagFrame":
        return replace(self, lineage=lineage)

    def selected(self, **kept) -> "TagFrame":
        roles = replace(self.roles, **kept)
        if not roles.packets:
            raise InputValidationError("a stream needs a packet column")
        return replace(self, df=self.df.select(*map(q, roles.columns)), roles=roles)

    def renamed(self, names: dict[str, str]) -> "TagFrame":
        return replace(self, df=self.df.withColumnsRenamed(names), roles=self.roles.renamed(names)) if names else self

    # --- values of a row: data, meta, source info, context

    def update(self, **values) -> "TagFrame":
        """New values (columns or literals) for existing tags and packets; type and order stay."""
        if missing := [c for c in values if c not in (*self.roles.tags, *self.roles.packets)]:
            raise KeyError(f"no such columns: {missing}")
        return self.having(self.df.withColumns({c: _column(v).cast(self.df.schema[c].dataType) for c, v in values.items()}))

    def with_columns(self, types: dict | None = None, **values) -> "TagFrame":
        """New packet columns, without source info."""
        if twice := [c for c in values if c in self.df.columns]:
            raise ValueError(f"columns exist: {twice}")
        kinds = types or {}
        new = {c: _column(v).cast(kinds[c]) if c in kinds else _column(v) for c, v in values.items()}
        roles = replace(self.roles, packets=(*self.roles.packets, *values))
        df = self.df.withColumns(new | {source_column(c): F.lit(None).cast("string") for c in values})
        return replace(self, df=df.select(*map(q, roles.columns)), roles=roles)

    def with_source_info(self, **info: str | None) -> "TagFrame":
        """Source strings of packets; names that aren't packets are left out."""
        return self.having(self.df.withColumns({source_column(p): F.lit(v).cast("string") for p, v in info.items() if p in self.roles.packets}))

    def with_meta(self, **values) -> "TagFrame":
        named = {c if c.startswith(META) else META + c: _column(v) for c, v in values.items()}
        roles = replace(self.roles, meta=(*self.roles.meta, *(c for c in named if c not in self.roles.meta)))
        return replace(self, df=self.df.withColumns(named).select(*map(q, roles.columns)), roles=roles)

    def drop_meta(self, *names: str) -> "TagFrame":
        gone = {c if c.startswith(META) else META + c for c in names}
        if missing := gone - set(self.roles.meta):
            raise KeyError(f"no such meta columns: {sorted(missing)}")
        roles = replace(self.roles, meta=tuple(c for c in self.roles.meta if c not in gone))
        return replace(self, df=self.df.select(*map(q, roles.columns)), roles=roles)

    def meta(self, name: str) -> Column:
        return F.col(q(name if name.startswith(META) else META + name))

    def with_context(self, key: str) -> "TagFrame":
        return replace(self, context=key)

    # --- fluent operators

    def join(self, *others: "TagFrame") -> "TagFrame":
        from .operators import Join

        return Join()(self, *others)

    def semi_join(self, other: "TagFrame") -> "TagFrame":
        from .operators import SemiJoin

        return SemiJoin()(self, other)

    def map_tags(self, name_map: dict[str, str], drop_unmapped: bool = True) -> "TagFrame":
        from .operators import MapTags

        return MapTags(name_map, drop_unmapped)(self)

    def map_packets(self, name_map: dict[str, str], drop_unmapped: bool = True) -> "TagFrame":
        from .operators import MapPackets

        return MapPackets(name_map, drop_unmapped)(self)

    def select_tags(self, columns, strict: bool = True) -> "TagFrame":
        from .operators import SelectTagColumns

        return SelectTagColumns(columns, strict)(self)

    def select_packets(self, columns, strict: bool = True) -> "TagFrame":
        from .operators import SelectPacketColumns

        return SelectPacketColumns(columns, strict)(self)

    def drop_tags(self, columns, strict: bool = True) -> "TagFrame":
        from .operators import DropTagColumns

        return DropTagColumns(columns, strict)(self)

    def drop_packets(self, columns, strict: bool = True) -> "TagFrame":
        from .operators import DropPacketColumns

        return DropPacketColumns(columns, strict)(self)

    def filter(self, *predicates: Column | str | bool, constraint_map: dict | None = None, **constraints) -> "TagFrame":
        from .operators import Filter

        return Filter(predicates, {**(constraint_map or {}), **constraints})(self)

    def batch(self, batch_size: int = 0, drop_partial_batch: bool = False) -> "TagFrame":
        from .operators import Batch

        return Batch(batch_size, drop_partial_batch)(self)

    # --- exports

    def keys(self) -> tuple[tuple[str, ...], tuple[str, ...]]:
        return self.roles.tags, self.roles.packets

    def types(self) -> tuple[dict, dict]:
        kind = lambda names: {n: self.df.schema[n].dataType for n in names}
        return kind(self.roles.tags), kind(self.roles.packets)

    def as_df(self, system_tags=False, source=False, content_hash: bool | str = False, context: bool | str | None = None, sort_by_tags=False, meta=False) -> DataFrame:
        """The DataFrame, with hidden columns on demand; nulls sort last."""
        r = self.roles
        columns = [*r.tags, *(r.system_tags if system_tags else ()), *r.packets, *(r.sources if source else ()), *(r.meta if meta else ())]
        out = [F.col(q(c)) for c in columns]
        if content_hash:
            out.append(row_hash(self.df, r.packets).alias(content_hash if isinstance(content_hash, str) else CONTENT_HASH))
        if context:
            out.append(F.lit(self.context if context is True else context).cast("string").alias(CONTEXT))
        df = self.df.select(*out)
        if sort_by_tags:
            df = df.orderBy(*(F.col(q(c)).asc_nulls_last() for c in (*r.tags, *(r.system_tags if system_tags else ()))))
        return df

    def as_table(self, sort_by_tags: bool = True, **flags):
        return self.as_df(sort_by_tags=sort_by_tags, **flags).toArrow()

    def as_pandas_df(self, index_by_tags: bool = True, **flags):
        df = self.as_df(sort_by_tags=True, **flags).toPandas()
        return df.set_index(list(self.roles.tags)) if index_by_tags and self.roles.tags else df

    def as_lazy_frame(self, **flags):
        import polars

        return polars.from_arrow(self.as_table(**flags)).lazy()

    def as_polars_df(self, **flags):
        return self.as_lazy_frame(**flags).collect()

    def _repr_html_(self) -> str:
        """The first rows; tags are starred."""
        names = [*("*" + t for t in self.roles.tags), *self.roles.packets]
        rows = self.as_df().limit(20).collect()
        cell = lambda tag, v: f"<{tag}>{escape(str(v))}</{tag}>"
        lines = ["".join(cell("th", n) for n in names), *("".join(cell("td", v) for v in r) for r in rows)]
        return "<table>" + "".join(f"<tr>{x}</tr>" for x in lines) + "</table>"

    def iter_records(self) -> Iterator["Record"]:
        from .records import Record

        r = self.roles
        for row in self.df.select(*map(q, r.columns)).toLocalIterator():
            d = row.asDict(True)
            pick = lambda names: {n: d[n] for n in names}
            yield Record(pick(r.tags), pick(r.packets), {p: d[source_column(p)] for p in r.packets}, pick(r.system_tags), pick(r.meta), self.context)

    def iter_packets(self) -> Iterator[tuple[dict, dict]]:
        for row in self.as_df(sort_by_tags=True).toLocalIterator():
            d = row.asDict(True)
            yield {t: d[t] for t in self.roles.tags}, {p: d[p] for p in self.roles.packets}

    def flow(self) -> list[tuple[dict, dict]]:
        return list(self.iter_packets())

    def view(self, rows: int = 20) -> None:
        self.df.select(*(F.col(q(t)).alias("*" + t) for t in self.roles.tags), *map(q, self.roles.packets)).show(rows)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession
