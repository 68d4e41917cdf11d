"""Tables written between steps, and versioned tables that many may read."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one only where that is unset."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = getattr(shared_folder, "own", None) or tempfile.mkdtemp(prefix="weftline-")
        shared_folder.own = named
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as Parquet in the shared folder: computed once, safe from lost executors."""
    path = f"{shared_folder(df.sparkSession)}/weftline/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


MANIFEST = re.compile(r"manifest-(\d+)\.json")


class ConcurrentWriteError(RuntimeError):
    """Another writer published the version that this one was about to publish."""


class VersionedTable:
    """Parquet folders and numbered manifests that list those of a version.

    A version is published by creating its manifest, which fails if there is one:
    two writers never overwrite each other, and no manifest is ever removed, so a
    crash at any step leaves the last version readable. A manifest that was cut
    off in writing doesn't count. All goes through Hadoop's file system, so any
    store that Spark reaches will do; a look costs a listing and one small read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._text = lambda stream: jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self) -> dict[int, object]:
        """File status of each manifest by number."""
        if not self._fs.exists(self._path(self.path)):
            return {}
        found = ((MANIFEST.fullmatch(f.getPath().getName()), f) for f in self._fs.listStatus(self._path(self.path)))
        return {int(m[1]): f for m, f in found if m}

    def _state(self) -> dict:
        listed = self._manifests()
        for n in sorted(listed, reverse=True):
            stream = self._fs.open(listed[n].getPath())
            try:
                return json.loads(self._text(stream)) | {"next": max(listed) + 1, "modified": listed[n].getModificationTime() / 1000}
            except ValueError:
                continue  # cut off
            finally:
                stream.close()
        return {"version": 0, "folders": [], "next": max(listed, default=0) + 1, "modified": None}

    def _publish(self, n: int, folders: list[str]) -> None:
        self._fs.mkdirs(self._path(self.path))
        try:
            out = self._fs.create(self._path(f"{self.path}/manifest-{n:012d}.json"), False)
        except Exception as e:
            if "AlreadyExists" in str(e):
                raise ConcurrentWriteError(f"{self.path} has a version {n}") from e
            raise
        out.write(bytearray(json.dumps({"version": n, "folders": folders}).encode()))
        out.close()

    @property
    def version(self) -> int:
        return self._state()["version"]

    @property
    def modified(self) -> float | None:
        """When the newest version was published, in seconds."""
        return self._state()["modified"]

    def exists(self) -> bool:
        return bool(self._state()["folders"])

    def read(self) -> DataFrame | None:
        folders = self._state()["folders"]
        return self.spark.read.option("mergeSchema", len(folders) > 1).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else None

    def append(self, df: DataFrame) -> int:
        return self._add(df, True)

    def replace(self, df: DataFrame) -> int:
        """The new content is written beside the old, so it may be computed from it."""
        return self._add(df, False)

    def compact(self) -> int:
        """All folders as one."""
        return self.replace(self.read())

    def _add(self, df: DataFrame, keep: bool) -> int:
        state = self._state()
        folder = f"v={state['next']}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.path}/{folder}")
        self._publish(state["next"], [*(state["folders"] if keep else []), folder])
        return state["next"]

    def delete(self) -> bool:
        return self._fs.delete(self._path(self.path), True)

    def below(self) -> list[str]:
        """Paths of the tables under this one's folder, relative to it."""
        found, open_ = [], [""]
        while open_:
            at = open_.pop()
            here = self._path(f"{self.path}/{at}") if at else self._path(self.path)
            if not self._fs.exists(here):
                continue
            names = [(f.getPath().getName(), f.isDirectory()) for f in self._fs.listStatus(here)]
            if any(MANIFEST.fullmatch(n) for n, d in names if not d):
                found.append(at)
            open_ += [f"{at}/{n}".lstrip("/") for n, d in names if d and n.startswith("p")]
        return sorted(found)


def folder_name(part: str) -> str:
    """A path part in characters that any store and Spark's listing accept."""
    return "p" + "".join(c if c.isalnum() or c in "-." else f"_{ord(c):x}_" for c in part)


def part_name(folder: str) -> str:
    """The path part of a :func:`folder_name`."""
    return re.sub(r"_([0-9a-f]+)_", lambda m: chr(int(m[1], 16)), folder[1:])
