"""Sources stamp provenance: a system tag per row, a source string per value."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..columns import SYSTEM_TAG, q, source_column
from ..errors import DuplicateTagError, SourceCollisionError
from ..frame import TagFrame, ordered_index
from ..functions.hashing import hash_object, schema_hash
from ..plans.files import VersionedTable


class SourceRegistry:
    def __init__(self):
        self._sources: dict[str, Source] = {}

    def register(self, source_id: str, source: "Source") -> None:
        old = self._sources.setdefault(source_id, source)
        if old is not source and old.reference != source.reference:
            raise SourceCollisionError(source_id)

    def get(self, source_id: str) -> "Source":
        return self._sources[source_id]

    def get_optional(self, source_id: str):
        return self._sources.get(source_id)

    def unregister(self, source_id: str):
        return self._sources.pop(source_id)

    def replace(self, source_id: str, source: "Source"):
        old = self._sources.get(source_id)
        self._sources[source_id] = source
        return old

    def __contains__(self, source_id: str) -> bool:
        return source_id in self._sources

    def list_sources(self, kind: type | None = None) -> list[str]:
        """Ids in the order of registration, of one type if asked for."""
        return [i for i, s in self._sources.items() if kind is None or isinstance(s, kind)]

    def info(self, source_id: str) -> dict:
        s = self._sources[source_id]
        return {"id": source_id, "type": type(s).__name__, "reference": s.reference}

    def clear(self) -> None:
        self._sources.clear()


GLOBAL = SourceRegistry()


class Source:
    """``frame()`` reads anew; rows are numbered by the tags, other columns breaking ties."""

    def __init__(self, tag_columns=(), source_name: str | None = None, registry: SourceRegistry | None = GLOBAL, provenance: bool = True, preserve_system_columns: bool = False):
        self.tags = tuple([tag_columns] if isinstance(tag_columns, str) else tag_columns)
        self.source_name, self.provenance, self.preserve = source_name, provenance, preserve_system_columns
        if registry is not None and source_name:
            registry.register(source_name, self)

    def read(self) -> DataFrame:
        raise NotImplementedError

    @property
    def reference(self) -> tuple:
        return (type(self).__name__, self.source_name or "", self.tags)

    def version(self):
        return None

    @property
    def source_id(self) -> str:
        return self.source_name or f"source:{hash_object(list(self.reference)).to_hex(12)}"

    def frame(self) -> TagFrame:
        df = self.read()
        if not self.preserve:
            df = df.select(*(q(c) for c in df.columns if not c.startswith("_")))
        lineage = hash_object(["source", [str(x) for x in self.reference], schema_hash(df), str(self.version())]).to_hex()
        if not self.provenance:
            return TagFrame.of(df, self.tags, lineage=lineage)
        mark = SYSTEM_TAG + "source:" + schema_hash(df)
        packets = [c for c in df.columns if c not in self.tags]
        df = ordered_index(df, self.tags, "__i")
        row = F.concat(F.lit(self.source_id + "::row_"), F.col("__i").cast("string"))
        df = df.select(*map(q, [*self.tags, *packets]), row.alias(mark), *(F.concat(row, F.lit("::" + p)).alias(source_column(p)) for p in packets if not p.startswith("_")))
        return TagFrame.of(df, self.tags, lineage=lineage)


def normalised(table: pa.Table) -> pa.Table:
    """Unsigned integers widened, null columns as strings, maps as lists of entries."""

    def kind(t: pa.DataType) -> pa.DataType:
        if pa.types.is_uint32(t):
            return pa.int64()
        if pa.types.is_uint64(t):
            return pa.decimal128(20, 0)
        if pa.types.is_null(t):
            return pa.string()
        if pa.types.is_fixed_size_list(t):
            return pa.list_(kind(t.value_type))
        if pa.types.is_map(t):
            return pa.list_(pa.struct([("key", kind(t.key_type)), ("value", kind(t.item_type))]))
        return t

    columns = []
    for f, c in zip(table.schema, table.columns):
        t = kind(f.type)
        if pa.types.is_map(f.type):
            c = pa.array([None if v is None else [{"key": k, "value": x} for k, x in v] for v in c.to_pylist()], t)
        elif t != f.type:
            c = pa.array(c.to_pylist(), t) if pa.types.is_decimal(t) or pa.types.is_list(t) else c.cast(t)
        columns.append(c)
    return pa.Table.from_arrays(columns, names=table.column_names)


class DataFrameSource(Source):
    """A Spark DataFrame, pandas DataFrame or Arrow table."""

    def __init__(self, spark: SparkSession, data, tag_columns=(), **options):
        self.spark, self.data = spark, data
        super().__init__(tag_columns, **options)
        if missing := [t for t in self.tags if t not in data.columns and t not in getattr(data, "column_names", ())]:
            raise ValueError(f"no such columns: {missing}")

    @property
    def reference(self):
        rows = self.data.semanticHash() if isinstance(self.data, DataFrame) else hash_object((self.data if isinstance(self.data, pa.Table) else pa.Table.from_pandas(self.data)).to_pydict(), str).to_hex()
        return ("dataframe", self.source_name or "", self.tags, str(rows))

    def read(self):
        if isinstance(self.data, DataFrame):
            return self.data
        return self.spark.createDataFrame(normalised(self.data) if isinstance(self.data, pa.Table) else self.data)


class DictSource(Source):
    """Rows as dicts, with an explicit schema (DDL or StructType) or an inferred one."""

    def __init__(self, spark: SparkSession, rows: list[dict], tag_columns=(), schema=None, **options):
        self.spark, self.rows, self.schema = spark, rows, schema
        super().__init__(tag_columns, **options)

    @property
    def reference(self):
        return ("dict", self.source_name or "", self.tags, hash_object(self.rows, str).to_hex())

    def read(self):
        if self.schema is not None:
            return self.spark.createDataFrame(self.rows, self.schema)
        return self.spark.createDataFrame(normalised(pa.Table.from_pylist(self.rows)))


class ListSource(Source):
    """One packet for each element; tags from ``tag_function(element, index)``."""

    def __init__(self, spark: SparkSession, name: str, data: list, tag_function=None, **options):
        self.spark, self.name, self.data = spark, name, data
        self.tag_function = tag_function or (lambda element, index: {"element_index": index})
        rows = [self.tag_function(x, i) for i, x in enumerate(data)]
        self.rows = [{**t, name: x} for t, x in zip(rows, data)]
        super().__init__(tuple(rows[0]) if rows else (), **options)

    @property
    def reference(self):
        return ("list", self.source_name or "", self.tags, hash_object(self.rows, str).to_hex())

    def read(self):
        return self.spark.createDataFrame(normalised(pa.Table.from_pylist(self.rows)))


class FrameSource(Source):
    """A frame that comes from elsewhere, as a source: provenance stays as it is."""

    def __init__(self, frame: TagFrame, **options):
        self._frame = frame
        super().__init__(frame.roles.tags, **options)

    def read(self):
        return self._frame.df

    @property
    def reference(self):
        return ("frame", self._frame.lineage, self.tags)

    def frame(self) -> TagFrame:
        return self._frame


class CSVSource(Source):
    def __init__(self, spark: SparkSession, path: str, tag_columns=(), schema=None, **options):
        self.spark, self.path, self.schema = spark, path, schema
        super().__init__(tag_columns, **options)

    def read(self):
        reader = self.spark.read.option("header", True)
        return (reader.schema(self.schema) if self.schema else reader.option("inferSchema", True)).csv(self.path)

    @property
    def reference(self):
        return ("csv", self.path, self.tags)


class ParquetSource(Source):
    def __init__(self, spark: SparkSession, path: str, tag_columns=(), **options):
        self.spark, self.path = spark, path
        super().__init__(tag_columns, **options)

    def read(self):
        return self.spark.read.parquet(self.path)

    @property
    def reference(self):
        return ("parquet", self.path, self.tags)


class GlobSource(Source):
    """Files that match a pattern: tag ``path``, packets ``content`` and ``length``."""

    def __init__(self, spark: SparkSession, pattern: str, **options):
        self.spark, self.pattern = spark, pattern
        super().__init__(("path",), **options)

    def read(self):
        return self.spark.read.format("binaryFile").load(self.pattern).select("path", "length", "content")


class VersionedSource(Source):
    """A versioned table; its identity is path, version and tags."""

    def __init__(self, spark: SparkSession, path: str, tag_columns=(), **options):
        self.spark, self.table = spark, VersionedTable(spark, path)
        super().__init__(tag_columns, **options)

    def read(self):
        return self.table.read()

    def version(self):
        return self.table.version

    @property
    def reference(self):
        return ("versioned", self.table.path, self.tags)

    @property
    def modified(self) -> float | None:
        """When the version that is read now was published, in seconds."""
        return self.table.modified

    def info(self) -> dict:
        df = self.read()
        return {"path": self.table.path, "version": self.version(), "modified": self.modified, "rows": df.count(), "schema": df.schema.simpleString(), "tags": self.tags}

    def resolve_field(self, row: dict | int, column: str):
        """The value that a row (its tags, or its number as in system tags) and a column name."""
        df = self.read()
        if isinstance(row, int):
            df = ordered_index(df, self.tags, "__i").where(F.col("__i") == row)
        for c, v in row.items() if isinstance(row, dict) else ():
            df = df.where(F.col(q(c)) == F.lit(v))
        row = df.select(q(column)).first()
        return None if row is None else row[0]


class ManualTableSource(VersionedSource):
    """A typed table that rows are inserted into, unique by tags."""

    def __init__(self, spark: SparkSession, path: str, schema, tag_columns=(), **options):
        super().__init__(spark, path, tag_columns, **options)
        self.schema = schema
        if not self.table.exists():
            self.table.replace(spark.createDataFrame([], schema))

    def insert(self, data, skip_duplicates: bool = False) -> int:
        """New version; rows whose tags exist raise, or are skipped."""
        if isinstance(data, dict):
            data = [data]
        if isinstance(data, pa.Table):
            data = normalised(data)
        new = data if isinstance(data, DataFrame) else self.spark.createDataFrame(data, self.schema) if isinstance(data, list) else self.spark.createDataFrame(data)
        old = self.read()
        new = new.select(*(F.col(q(f.name)).cast(f.dataType).alias(f.name) for f in old.schema))
        if self.tags:
            tags = list(self.tags)
            if not skip_duplicates:
                twice = new.groupBy(*map(q, tags)).count().where("count > 1")
                if twice.limit(1).count() or new.join(old, tags, "left_semi").limit(1).count():
                    raise DuplicateTagError(f"tags {tags} exist")
            new = new.dropDuplicates(tags).join(old.select(*map(q, tags)), tags, "left_anti").select(*map(q, old.columns))
        return self.table.append(new)
