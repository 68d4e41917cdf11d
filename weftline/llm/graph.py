"""Connected components of links between long keys, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``k, c``: every key of a link with the smallest key of its component.

    Each round a key takes the smallest label among its neighbours', its own and its
    own label's label (pointer jumping), so rounds grow with the logarithm of the
    longest chain. Labels are written once a round; links never reach the driver.
    Links of a hot key are minimised within tasks first.
    """
    edges = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    both = materialise(edges.union(edges.select("y", "x")).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("x").alias("k")).agg(F.least(F.min("y"), F.col("x")).alias("c")), "labels")
    while True:
        near = both.join(labels, F.col("y") == F.col("k")).groupBy("x").agg(F.min("c").alias("m"))
        up = labels.select(F.col("k").alias("p"), F.col("c").alias("pc"))  # a label is a key itself
        new = labels.join(near, F.col("k") == F.col("x")).join(up, F.col("c") == F.col("p"))
        n = F.least("c", "m", "pc")
        new = materialise(new.select("k", n.alias("c"), (n < F.col("c")).alias("moved")), "labels")
        discard(labels)
        labels = new
        if not new.where("moved").limit(1).count():
            discard(both)
            return labels.select("k", "c")
