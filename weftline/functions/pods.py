"""Pods: typed Python functions of packets, computed once for equal packets, optionally remembered."""

from __future__ import annotations

import hashlib
import inspect
import logging
import re
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import CONTEXT, META, Roles, q, source_column
from ..errors import InputValidationError
from ..frame import TagFrame
from ..plans.files import written
from ..plans.tracking import no_tracking, record
from .hashing import content_of_paths, function_info, git_version, hash_object, row_hash
from .typing import fits, function_types, spark_type, to_python, to_spark

PACKET = META + "input_packet_hash"
RECORD = META + "packet_id"
WHEN = META + "pod_ts"
ENGINE = META + "execution_engine"


class FunctionPod:
    """The outputs of ``function`` replace the packet; tags are kept.

    ``error_handling``: ``raise``, or ``ignore`` / ``warn`` to drop the row; with
    ``warn`` each is logged by its worker and counted in ``dropped`` on the driver.
    A path among the inputs is known by the content of its file. ``engine`` names
    what computes the results; it is recorded with them.
    """

    def __init__(self, function, output_keys=(), function_name=None, version="v0.0", label=None, input_schema=None, output_schema=None, active=True, error_handling="raise", engine="spark"):
        if function.__name__ == "<lambda>" and not function_name:
            raise ValueError("a lambda has no name to be known by")
        self.function, self.name, self.version = function, function_name or function.__name__, version
        self.output_keys = [output_keys] if isinstance(output_keys, str) else list(output_keys)
        self.inputs, self.outputs = function_types(function, self.output_keys, input_schema, output_schema)
        self.label, self.active, self.error_handling, self.engine = label or self.name, active, error_handling, engine
        self.dropped = None
        found = re.search(r"\d+", version)
        self.major = int(found[0]) if found else 0
        self.output_type = T.StructType([T.StructField(k, spark_type(h)) for k, h in self.outputs.items()])

    @property
    def reference(self) -> tuple[str, str, str]:
        """Name, type of outputs and major version: where results are kept."""
        return self.name, hash_object(self.output_type.simpleString()).to_hex(12), f"v{self.major}"

    @property
    def tiers(self) -> dict[str, str]:
        source = function_info(self.function)["source"] or self.name
        try:
            commit = git_version(inspect.getfile(self.function))
        except TypeError:
            commit = None
        return {
            "version": self.version,
            "signature": hash_object(self.function).to_hex(),
            "content": hashlib.sha256(source.encode()).hexdigest()[:20],
            "git": commit or "",
        }

    def identity(self, lineage: str) -> str:
        return hash_object(["pod", list(self.reference), lineage]).to_hex()

    def check(self, frame: TagFrame) -> None:
        for p in frame.roles.packets:
            if p not in self.inputs:
                raise InputValidationError(f"{self.name} has no parameter {p}")
            if not fits(frame.df.schema[p].dataType, spark_type(self.inputs[p])):
                raise InputValidationError(f"{p} is {frame.df.schema[p].dataType.simpleString()}, {self.name} takes {self.inputs[p]}")
        needed = {n for n, p in inspect.signature(self.function).parameters.items() if p.default is p.empty}
        if missing := needed - set(frame.roles.packets):
            raise InputValidationError(f"{self.name} misses {sorted(missing)}")

    def joined(self, frames) -> TagFrame:
        with no_tracking():
            return frames[0].join(*frames[1:]) if len(frames) > 1 else frames[0]

    def compute(self, packets: DataFrame, names, keep) -> DataFrame:
        """``keep`` columns and outputs of every row: one pass, Arrow batches."""
        function, inputs, outputs, handling = self.function, self.inputs, self.outputs, self.error_handling
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = T.StructType([packets.schema[k] for k in keep] + list(self.output_type))
        arrow = to_arrow_schema(schema)
        keep, names, label = list(keep), list(names), self.name
        if handling == "warn" and self.dropped is None:
            self.dropped = packets.sparkSession.sparkContext.accumulator(0)
        dropped = self.dropped

        def run(batches):
            for batch in batches:
                rows = []
                for row in batch.to_pylist():
                    try:
                        value = function(**{n: to_python(row[n], inputs[n]) for n in names})
                        values = (value,) if len(outputs) == 1 else () if not outputs else tuple(value)
                        if len(values) != len(outputs):
                            raise ValueError(f"{label} returned {len(values)} values for {len(outputs)} keys")
                        rows.append({k: row[k] for k in keep} | {k: to_spark(v, h) for v, (k, h) in zip(values, outputs.items())})
                    except Exception:
                        if handling == "raise":
                            raise
                        if handling == "warn":
                            logging.getLogger("weftline").warning("%s failed for a packet", label, exc_info=True)
                            dropped.add(1)
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

        return packets.select(*(q(c) for c in dict.fromkeys([*keep, *names]))).mapInArrow(run, schema)

    def record_id(self, packet_hash):
        return F.concat(F.lit("sha256@"), F.substring(F.sha2(F.concat(packet_hash, F.lit(hash_object(list(self.reference)).to_hex()), F.lit(self.engine)).cast("binary"), 256), 1, 20))

    def hashed(self, frame: TagFrame) -> TagFrame:
        paths = {p: content_of_paths(F.col(q(p))["path"]) for p in frame.roles.packets if self.inputs.get(p) is Path}
        return frame.having(frame.df.withColumn(PACKET, row_hash(frame.df, frame.roles.packets, 64, paths)))

    def source(self, key: str):
        """Where an output comes from: the pod, the record and the key."""
        return F.concat_ws("::", F.lit(":".join(self.reference)), self.record_id(F.col(PACKET)), F.lit(key))

    def finish(self, frame: TagFrame, tagged: DataFrame) -> TagFrame:
        """Roles and provenance of outputs; ``tagged`` has PACKET and the output columns."""
        roles = Roles(frame.roles.tags, tuple(self.output_keys), frame.roles.system_tags)
        sources = [self.source(k).alias(source_column(k)) for k in self.output_keys]
        return TagFrame(tagged.select(*map(q, (*roles.tags, *roles.system_tags, *self.output_keys)), *sources), roles, frame.lineage)

    def results(self, frame: TagFrame) -> DataFrame:
        """PACKET and outputs of the distinct packets of a hashed frame."""
        distinct = frame.df.select(PACKET, *map(q, frame.roles.packets)).dropDuplicates([PACKET])
        return self.compute(distinct, frame.roles.packets, [PACKET])

    def apply(self, frame: TagFrame) -> TagFrame:
        hashed = self.hashed(frame)
        tags = hashed.df.select(*map(q, (*frame.roles.tags, *frame.roles.system_tags)), PACKET)
        if not self.active:
            return self.finish(frame, tags.limit(0).select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in self.output_type)))
        return self.finish(frame, tags.join(self.results(hashed), PACKET))

    def __call__(self, *frames: TagFrame) -> TagFrame:
        frame = self.joined(frames)
        self.check(frame)
        out = self.apply(frame).derived(self.identity(frame.lineage))
        return record(self, frames, out)


class WrappedPod:
    """Another pod under a label of its own; what isn't overridden here is the other's."""

    def __init__(self, pod: FunctionPod, label: str | None = None):
        self.pod, self.label = pod, label or pod.label

    def __getattr__(self, name):
        if name == "pod":
            raise AttributeError(name)
        return getattr(self.pod, name)

    def __call__(self, *frames: TagFrame) -> TagFrame:
        with no_tracking():
            out = self.pod(*frames)
        return record(self, frames, out)


def function_pod(output_keys=(), function_name=None, version="v0.0", label=None, **options):
    return lambda f: FunctionPod(f, output_keys, function_name, version, label, **options)


class CachedPod:
    """A pod whose results are kept in a record store by packet hash.

    A record has the packet's hash, the pod's tiers, outputs with their sources, the
    context, the engine and the time. Only packets without a result are computed; new results are written first and
    read back, so what is recorded is what is returned. In ``development`` mode
    nothing is looked up or recorded. Of several results the latest counts.
    """

    def __init__(self, pod: FunctionPod, store, path_prefix=(), mode: str = "production", match_tier: str | None = None):
        self.pod, self.store, self.prefix, self.mode, self.match_tier = pod, store, tuple(path_prefix), mode, match_tier
        self.label = pod.label

    @property
    def path(self) -> tuple[str, ...]:
        return (*self.prefix, *self.pod.reference)

    def identity(self, lineage: str) -> str:
        return self.pod.identity(lineage)

    def stored(self) -> DataFrame | None:
        found = self.store.all_records(self.path, RECORD)
        if found is None:
            return None
        if self.match_tier:
            found = found.where(F.col(f"{META}pod_id_{self.match_tier}") == self.pod.tiers[self.match_tier])
        w = Window.partitionBy(PACKET).orderBy(F.desc(WHEN), F.desc(RECORD))  # a record's id tells those of one moment apart
        return found.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").select(PACKET, *map(q, self.pod.output_keys))

    def missing(self, hashed: TagFrame) -> TagFrame:
        old = self.stored()
        return hashed if old is None else hashed.having(hashed.df.join(old.select(PACKET), PACKET, "left_anti"))

    def __call__(self, *frames: TagFrame) -> TagFrame:
        frame = self.pod.joined(frames)
        self.pod.check(frame)
        if self.mode == "development" or not self.pod.active:
            out = self.pod.apply(frame)
        else:
            hashed = self.pod.hashed(frame)
            new = written(self.pod.results(self.missing(hashed)), "results")
            tiers = [F.lit(v).alias(f"{META}pod_id_{k}") for k, v in self.pod.tiers.items()]
            named = F.concat_ws("/", self.pod.record_id(F.col(PACKET)), *(F.lit(v) for v in self.pod.tiers.values()))
            sources = [self.pod.source(k).alias(source_column(k)) for k in self.pod.output_keys]
            rest = [F.lit(frame.context).cast("string").alias(CONTEXT), F.lit(self.pod.engine).alias(ENGINE), F.current_timestamp().alias(WHEN)]
            rows = new.select(named.alias(RECORD), "*", *tiers, *sources, *rest)
            self.store.add_records(self.path, rows, RECORD)
            tags = hashed.df.select(*map(q, (*frame.roles.tags, *frame.roles.system_tags)), PACKET)
            out = self.pod.finish(frame, tags.join(self.stored(), PACKET))
        return record(self, frames, out.derived(self.identity(frame.lineage)))
