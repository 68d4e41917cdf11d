"""Labelled rows to learn from: a bounded sample, split by a checksum of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise


def remainder(key: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts`` (null for a null id)."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


def held_out(key: str, parts: int, part: int) -> Column:
    """Whether a row is kept out of learning; a row without an id is."""
    return F.coalesce(remainder(key, parts) == part, F.lit(True))


def labelled(docs: DataFrame, labels: DataFrame, label: str, parts: int, part: int, rows: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, text, label`` of at most ``rows`` labelled rows outside the held-out part.

    The ids with the smallest hashes are taken, so the sample is the same at
    every partitioning. It is written to the shared folder once: its size is
    bounded by ``rows``, so the ids can be broadcast.
    """
    marked = (
        labels.select(F.col(key), F.col(label).cast("int").alias("label"))
        .where(F.col(key).isNotNull() & F.col("label").isNotNull() & ~held_out(key, parts, part))
        .groupBy(key)
        .agg(F.max("label").alias("label"))
    )
    # repeated documents share a label row; one text of each id is learned from
    ids = F.broadcast(marked.orderBy(F.xxhash64(key), key).limit(rows))
    found = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text")).join(ids, key)
    return materialise(found.groupBy(key, "label").agg(F.min("text").alias("text")).select(key, "text", "label").repartition(max(1, rows // 1000)), f"sample-{label}")
