"""Keyed record tables by path: the first record of an id stays, within a write the last one counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..columns import q
from .files import VersionedTable, folder_name, part_name, written

ID = "__record_id"


class RecordStore:
    """Records that are queued (``flush=False``) are written once there are ``batch_size`` of them."""

    def __init__(self, spark: SparkSession, base_path: str, batch_size: int = 1000, max_depth: int = 10):
        self.spark, self.base_path, self.batch_size, self.max_depth = spark, base_path.rstrip("/"), batch_size, max_depth
        self.pending: dict[tuple, list[DataFrame]] = {}

    def table(self, path: tuple[str, ...]) -> VersionedTable:
        if not path or len(path) > self.max_depth or not all(path):
            raise ValueError(f"not a record path: {path}")
        return VersionedTable(self.spark, "/".join([self.base_path, *map(folder_name, path)]))

    def add_record(self, path, record_id: str, df: DataFrame, **options) -> None:
        self.add_records(path, df.withColumn(ID, F.lit(record_id)), ID, **options)

    def add_records(self, path, df: DataFrame, record_id_column: str | None = None, skip_duplicates: bool = False, flush: bool = True, schema_handling: str = "error", order: str | None = None) -> None:
        """Queue records (``order``: the column that says which of an id is last)."""
        path = tuple(path)
        key = record_id_column or df.columns[0]
        df = df.withColumnRenamed(key, ID)
        w = Window.partitionBy(ID).orderBy(F.col(q(order)).desc() if order else F.monotonically_increasing_id().desc())
        df = df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")
        if skip_duplicates and (old := self.all_records(path, ID)) is not None:
            df = df.join(old.select(ID), ID, "left_anti")
        known = self.all_records(path, ID)
        if known is not None and known.schema.simpleString() != df.select(*(c for c in known.columns if c in df.columns), *(c for c in df.columns if c not in known.columns)).schema.simpleString():
            if schema_handling == "error":
                raise ValueError(f"schema {df.schema.simpleString()} differs from {known.schema.simpleString()}")
            if schema_handling == "coerce":
                df = df.select(*((F.col(q(f.name)) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in known.schema))
        self.pending.setdefault(path, []).append(df)
        if flush or sum(d.count() for d in self.pending[path]) >= self.batch_size:
            self.flush_path(path)

    def flush_path(self, path) -> None:
        """Insert what is absent; queued records stay queued if it fails."""
        path = tuple(path)
        table = self.table(path)
        for df in list(self.pending.get(path, ())):
            old = table.read()
            new = df if old is None else df.join(old.select(ID), ID, "left_anti")
            table.append(new)
            self.pending[path].pop(0)
        self.pending.pop(path, None)

    def flush(self) -> None:
        for path in list(self.pending):
            self.flush_path(path)

    def all_records(self, path, record_id_column: str | None = None, pending: bool = True) -> DataFrame | None:
        """Stored and queued records; the id column is dropped unless it is named."""
        path = tuple(path)
        found = self.table(path).read()
        for df in self.pending.get(path, ()) if pending else ():
            found = df if found is None else found.unionByName(df.join(found.select(ID), ID, "left_anti"), allowMissingColumns=True)
        return self._named(found, record_id_column)

    def _named(self, df, name):
        if df is None or name == ID:
            return df
        return df.withColumnRenamed(ID, name) if name else df.drop(ID)

    def records_with(self, path, values, record_id_column: str | None = None) -> DataFrame | None:
        """Conjunction of equalities, pushed to the files."""
        df = self.all_records(path, ID)
        for c, v in values.items() if isinstance(values, dict) else values:
            df = df if df is None else df.where(F.col(q(c)) == F.lit(v))
        return self._named(df, record_id_column)

    def record_by_id(self, path, record_id: str, record_id_column: str | None = None) -> DataFrame | None:
        df = self.all_records(path, ID)
        return self._named(df if df is None else df.where(F.col(ID) == F.lit(record_id)), record_id_column)

    def records_by_ids(self, path, ids, record_id_column: str | None = None, preserve_order: bool = False) -> DataFrame | None:
        """Records of listed ids (or of the first column of a DataFrame of any size).

        With ``preserve_order`` every listed id has a row, of nulls if missing.
        """
        df = self.all_records(path, ID)
        if df is None:
            return None
        if isinstance(ids, DataFrame):
            return self._named(df.join(ids.select(F.col(q(ids.columns[0])).alias(ID)), ID, "left_semi"), record_id_column)
        if not preserve_order:
            return self._named(df.where(F.col(ID).isin(list(ids))), record_id_column)
        wanted = self.spark.createDataFrame(list(enumerate(ids)), "__at long, " + ID + " string")
        return self._named(wanted.join(df, ID, "left").orderBy("__at").drop("__at"), record_id_column)

    def overwrite_records(self, path, df: DataFrame, record_id_column: str | None = None) -> None:
        """Records of an id are replaced."""
        key = record_id_column or df.columns[0]
        new = written(df.withColumnRenamed(key, ID).dropDuplicates([ID]), "records")
        old = self.table(path).read()
        self.table(path).replace(new if old is None else old.join(new.select(ID), ID, "left_anti").unionByName(new, allowMissingColumns=True))

    def delete_record(self, path, record_id: str) -> bool:
        old = self.table(path).read()
        if old is None or not old.where(F.col(ID) == record_id).limit(1).count():
            return False
        self.table(path).replace(old.where(F.col(ID) != record_id))
        return True

    def delete_table(self, path) -> bool:
        self.pending.pop(tuple(path), None)
        return self.table(path).delete()

    def tables(self) -> list[tuple[str, ...]]:
        """The paths that hold records."""
        return [tuple(map(part_name, p.split("/"))) for p in VersionedTable(self.spark, self.base_path).below()]

    def info(self, path) -> dict:
        df = self.table(path).read()
        return {"version": self.table(path).version, "rows": 0 if df is None else df.count(), "pending": len(self.pending.get(tuple(path), ())), "schema": None if df is None else df.schema.simpleString()}


class ReadThroughStore:
    """Looks records up in a near store, then in a far one, and keeps what it fetched."""

    def __init__(self, near: RecordStore, far: RecordStore):
        self.near, self.far = near, far

    def record_by_id(self, path, record_id: str):
        found = self.near.record_by_id(path, record_id, ID)
        if found is not None and found.limit(1).count():
            return found.drop(ID)
        found = self.far.record_by_id(path, record_id, ID)
        if found is not None and found.limit(1).count():
            self.near.add_records(path, found, ID)
            return found.drop(ID)
        return None
