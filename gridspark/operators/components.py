"""Connected components of a graph by rounds of minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import staged


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component), where component is the least node that paths reach; labels are halved along by pointer jumps,
    so rounds grow with the logarithm of a part's diameter.  Edges with a NULL end add nothing."""
    e = staged(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v")).distinct(), "edges")
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = staged(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("l")), "labels")
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        low = labels.join(near, "u").select("u", "l", F.least("l", "m").alias("m"))
        # A node's label also learns what its neighbours know of it, then labels take their own label's label.
        told = low.groupBy(F.col("l").alias("u")).agg(F.min("m").alias("t"))
        low = low.join(told, "u", "left").select("u", "l", F.least("m", F.coalesce("t", "m")).alias("m"))
        jump = low.select(F.col("u").alias("w"), F.col("m").alias("j"))
        new = staged(low.join(jump, F.col("m") == F.col("w")).select("u", F.least("m", "j").alias("l"), (F.least("m", "j") != F.col("l")).alias("moved")), "labels")
        if new.where("moved").isEmpty():
            return new.select(F.col("u").alias("node"), F.col("l").alias("component"))
        labels = new.select("u", "l")
