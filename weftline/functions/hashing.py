"""Content hashes: of rows as expressions, of tables as aggregates, of objects on the driver."""

from __future__ import annotations

import base64
import hashlib
import inspect
import json
import sqlite3
import subprocess
import uuid
import zlib
from collections import OrderedDict
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import q


@dataclass(frozen=True)
class ContentHash:
    method: str
    digest: bytes

    def to_hex(self, chars: int | None = 20) -> str:
        return self.digest.hex()[:chars]

    def to_int(self, chars: int = 16) -> int:
        return int(self.to_hex(chars), 16)

    def to_uuid(self) -> uuid.UUID:
        return uuid.UUID(bytes=self.digest[:16])

    def to_base64(self) -> str:
        return base64.b64encode(self.digest).decode()

    def to_string(self, chars: int | None = 20) -> str:
        return f"{self.method}@{self.to_hex(chars)}"

    def display_name(self, chars: int = 20) -> str:
        return f"{self.method}:{self.to_hex(chars)}"

    @classmethod
    def from_string(cls, text: str) -> "ContentHash":
        method, _, digest = text.partition("@")
        return cls(method, bytes.fromhex(digest))


def combine_hashes(*hashes: str, order: bool = False, prefix: str | None = None, chars: int | None = 20) -> str:
    digest = hashlib.sha256("".join(sorted(hashes) if order else hashes).encode()).hexdigest()[:chars]
    return f"{prefix}@{digest}" if prefix else digest


def hash_object(value, other=None) -> ContentHash:
    """Hash of a nested Python structure; order of sets and dict keys does not matter.

    ``other`` turns values of types without a rule into some that have one.
    """

    def plain(x):
        if x is None or isinstance(x, (bool, int, float, str)):
            return x
        if isinstance(x, bytes):
            return {"bytes": x.hex()}
        if isinstance(x, (Path, uuid.UUID)):
            raise TypeError(f"{type(x).__name__} has no content of its own to hash")
        if isinstance(x, ContentHash):
            return {"hash": x.to_string(64)}
        if isinstance(x, type):
            return f"type:{x.__module__}.{x.__qualname__}"
        if isinstance(x, dict):
            return {"dict": sorted(([plain(k), plain(v)] for k, v in x.items()), key=json.dumps)}
        if isinstance(x, (set, frozenset)):
            return {"set": sorted(map(plain, x), key=json.dumps)}
        if isinstance(x, (list, tuple)):
            return {type(x).__name__: list(map(plain, x))}
        if callable(x):
            return {"function": x.__name__, "signature": str(inspect.signature(x))}
        if other is not None:
            return {type(x).__name__: plain(other(x))}
        raise TypeError(f"no rule to hash {type(x).__name__}")

    return ContentHash("sha256", hashlib.sha256(json.dumps(plain(value), sort_keys=True).encode()).digest())


def encoded(c: Column, kind: T.DataType) -> Column:
    """Text that two values of a type share only if they are equal; null has its own."""
    if isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: encoded(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.StructType):
        text = F.concat(F.lit("{"), *(F.concat(F.lit(f.name + "="), encoded(c[f.name], f.dataType), F.lit(";")) for f in kind), F.lit("}"))
    elif isinstance(kind, T.MapType):
        text = encoded(F.array_sort(F.map_entries(c)), T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])))
    elif isinstance(kind, T.BinaryType):
        text = F.hex(c)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = F.when(c == 0, F.lit("0.0")).otherwise(c.cast("string"))
    else:
        text = c.cast("string")
    return F.coalesce(F.concat(F.lit(kind.typeName() + ":"), F.length(text).cast("string"), F.lit(":"), text), F.lit("null"))


def row_hash(df: DataFrame, columns, chars: int = 20, instead: dict[str, Column] | None = None) -> Column:
    """``sha256@`` and hex of named values, independent of column order; 64 digits to tell rows apart.

    ``instead``: texts that stand for the values of some columns.
    """
    given = instead or {}
    parts = [F.concat(F.lit(c + "="), given[c] if c in given else encoded(F.col(q(c)), df.schema[c].dataType)) for c in sorted(columns)]
    return F.concat(F.lit("sha256@"), F.substring(F.sha2(F.concat_ws("\n", *parts).cast("binary"), 256), 1, chars))


def table_hash(df: DataFrame) -> ContentHash:
    """Hash of a table's rows in any order: digests are summed, so it is one aggregate."""
    h = row_hash(df, df.columns, 64)
    word = lambda i: F.conv(F.substring(h, 8 + 15 * i, 15), 16, 10).cast("decimal(38,0)")
    got = df.select(*(word(i).alias(f"w{i}") for i in range(4))).agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"w{i}").alias(f"w{i}") for i in range(4))).first()
    return hash_object([got.n, *(str(got[f"w{i}"] or 0) for i in range(4)), sorted(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema)])


def schema_hash(df: DataFrame, chars: int = 12) -> str:
    return hash_object([[f.name, f.dataType.simpleString()] for f in df.schema]).to_hex(chars)


def file_hash(path: str, algorithm: str = "sha256") -> ContentHash:
    """Hash of a file's bytes, read piece by piece; ``path`` as algorithm hashes the name alone."""
    import xxhash

    if algorithm == "path":
        return ContentHash("path", hashlib.sha256(str(path).encode()).digest())
    crc, state = 0, None if algorithm == "crc32" else xxhash.xxh64() if algorithm == "xxh64" else hashlib.new(algorithm)
    with open(path, "rb") as f:
        while piece := f.read(1 << 20):
            if state is None:
                crc = zlib.crc32(piece, crc)
            else:
                state.update(piece)
    return ContentHash(algorithm, crc.to_bytes(4, "big") if state is None else state.digest())


def path_hash(path: str, algorithm: str = "sha256") -> ContentHash:
    """Hash of a file, or of a folder's files by their names within it."""
    if Path(path).is_dir():
        files = sorted(f for f in Path(path).rglob("*") if f.is_file())
        return hash_object({f.relative_to(path).as_posix(): file_hash(str(f), algorithm) for f in files})
    return file_hash(path, algorithm)


class CachedFileHasher:
    """File hashes kept by path, size and time of change: a changed file is hashed again.

    The ``size`` hashes asked for last stay in memory; with ``store`` (a SQLite file)
    all of them outlive the process.
    """

    def __init__(self, algorithm: str = "sha256", size: int = 1000, store: str | None = None):
        self.algorithm, self.size, self.memory = algorithm, size, OrderedDict()
        self.store = sqlite3.connect(store) if store else None
        if self.store:
            self.store.execute("CREATE TABLE IF NOT EXISTS hashes (key TEXT PRIMARY KEY, hash TEXT)")

    def __call__(self, path: str) -> ContentHash:
        stat = Path(path).stat()
        key = f"{self.algorithm}:{Path(path).resolve()}:{stat.st_size}:{stat.st_mtime_ns}"
        found = self.memory.get(key)
        if found is None and self.store and (row := self.store.execute("SELECT hash FROM hashes WHERE key = ?", (key,)).fetchone()):
            found = row[0]
        if found is None:
            found = file_hash(path, self.algorithm).to_string(None)
            if self.store:
                with self.store:
                    self.store.execute("INSERT OR REPLACE INTO hashes VALUES (?, ?)", (key, found))
        self.memory[key] = found
        self.memory.move_to_end(key)
        while len(self.memory) > self.size:
            self.memory.popitem(last=False)
        return ContentHash.from_string(found)

    def clear(self) -> None:
        self.memory.clear()
        if self.store:
            with self.store:
                self.store.execute("DELETE FROM hashes")


def function_info(function) -> dict[str, str]:
    """Name, module, signature and source text of a function, as far as they are known."""
    try:
        source = inspect.getsource(function)
    except (OSError, TypeError):
        source = ""
    return {"name": function.__name__, "module": function.__module__, "signature": str(inspect.signature(function)), "source": source}


def git_version(path: str) -> str | None:
    """The commit of the repository that a file is in, ``-dirty`` with changes; None outside one."""
    git = lambda *a: subprocess.run(["git", "-C", str(Path(path).parent), *a], capture_output=True, text=True, timeout=10)
    try:
        head = git("rev-parse", "HEAD")
        return head.stdout.strip() + ("-dirty" if git("status", "--porcelain").stdout.strip() else "") if head.returncode == 0 else None
    except (OSError, subprocess.TimeoutExpired):
        return None


def content_of_paths(path: Column) -> Column:
    """Hash of the file that each path names, read by the tasks; null for null."""

    @F.pandas_udf("string")
    def read(paths: pd.Series) -> pd.Series:
        hasher = CachedFileHasher()
        return paths.map(lambda p: None if p is None else hasher(p).to_string(64))

    return read(path)


def file_hashes(spark, pattern: str) -> DataFrame:
    """``path, hash`` of files that only Spark need reach."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.concat(F.lit("sha256@"), F.sha2("content", 256)).alias("hash"))
