"""Shared helpers of the training-data operators.

Every operator that runs Python goes through :func:`map_rows`: Arrow batches are
cut into slices of bounded bytes, so a worker holds one slice of text whatever
the size of the table, the partition or the Arrow batch.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20
SLICE_ROWS = 2048
#: Rows of an Arrow batch while a step is written: the JVM and the worker each hold a batch whole.
ARROW_ROWS = "2000"
#: Seconds after which a step begins with a collection in the executors.
REST_S = 15
WHILE_WRITING = {"spark.sql.execution.arrow.maxRecordsPerBatch": ARROW_ROWS, "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read by Spark so that any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quoted(name: str) -> str:
    """A column name as Spark's parser reads it: dots and backticks are part of it."""
    return "`" + name.replace("`", "``") + "`"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what ``spark.checkpoint.dir`` names. Only where that is unset (tests on
    one machine) is a local temporary folder made and set as checkpoint folder.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = getattr(shared_dir, "own", None)
        if named is None or not os.path.isdir(named):
            named = shared_dir.own = tempfile.mkdtemp(prefix="weftline-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def rest(spark: SparkSession) -> None:
    """Full collections in the executors: a heap that grew in earlier steps shrinks before the next.

    Otherwise it only grows over a session, and workers need room beside it.
    """
    if time.monotonic() - getattr(rest, "last", 0.0) >= REST_S:
        n = spark.sparkContext.defaultParallelism
        spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc') AS done").write.format("noop").mode("overwrite").save()
        rest.last = time.monotonic()


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage; the files survive the loss of any executor. While it is
    written, Arrow batches are small and Spark drops the step's shuffle files at
    its end (nothing reads them again); both settings are then put back.
    """
    spark = df.sparkSession
    rest(spark)
    path = f"{shared_dir(spark)}/weftline/{label}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in WHILE_WRITING}
    for k, v in WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def discard(*steps: DataFrame) -> None:
    """Delete the files of materialised steps that nothing reads any more."""
    for df in steps:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def frugal() -> None:
    """Have a worker give large freed blocks back to the system instead of keeping them."""
    pa.set_memory_pool(pa.system_memory_pool())
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):  # fixed values of glibc: M_MMAP_THRESHOLD, M_TRIM_THRESHOLD
        libc.mallopt(-3, 2 << 20)
        libc.mallopt(-1, 4 << 20)


def trim() -> None:
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow``, in workers that hold no more memory between tasks than they must.

    Columns may have any names: Spark looks them up unquoted, so it gets plain ones.
    """
    names = df.columns

    def bounded(batches):
        frugal()
        try:
            yield from run(b.rename_columns(names) for b in batches)
        finally:
            trim()

    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(bounded, schema)


def most_frequent(df: DataFrame, n: str, rows: int) -> DataFrame:
    """The rows of ``df`` with the largest ``n``, ``rows`` at most: of equal ``n`` all or none.

    Only the distinct values of ``n`` come to the driver (counts that add up to N
    have fewer than the root of 2 N), never the candidates of every task.
    """
    least, held = None, 0
    for value, m in sorted((tuple(r) for r in df.groupBy(n).agg(F.count(F.lit(1))).collect()), reverse=True):
        held += m
        if held > rows:
            break
        least = value
    return df.where(F.lit(False) if least is None else F.col(n) >= F.lit(least))


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into slices of about ``limit`` bytes (always at least a row)."""
    rows = batch.num_rows
    if rows == 0:
        return
    step = max(1, min(SLICE_ROWS, int(rows * limit / max(1, batch.nbytes))))
    for start in range(0, rows, step):
        yield batch.slice(start, step)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def map_rows(
    df: DataFrame,
    make: Callable[[], Callable[..., dict[str, Sequence]]],
    ddl: str,
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """Apply ``make()`` once per task and its result once per slice.

    The function gets one Python list for each column of ``df`` and returns a
    dict of equally long columns for the schema ``ddl``.
    """
    from pyspark.sql.types import StructType

    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in slices(batch, limit):
                out = fn(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in ((out[f.name], f) for f in schema)],
                    schema=schema,
                )

    return map_batches(df, run, StructType.fromDDL(ddl))


def utf8(text: str | bytes | None) -> bytes:
    """A text as UTF-8; null counts as empty, bytes stay as they are."""
    return b"" if text is None else text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")
