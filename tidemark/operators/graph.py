"""Connected components of links between rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


def components(links: DataFrame, a: str, b: str, most: int = 100) -> DataFrame:
    """(node, component): the least node that each node of a link reaches.

    Every step takes the least label of a node's neighbours and then that label's own, so that paths halve; each step is a written table of one
    row a node, and the last one changes nothing."""
    e = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v")
    e = written(e.union(e.select("v", "u")).distinct(), "links")
    labels = written(e.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("l")), "labels")
    for _ in range(most):
        near = e.join(labels.select(F.col("u").alias("v"), F.col("l").alias("m")), "v").groupBy("u").agg(F.min("m").alias("m"))
        low = labels.join(near, "u").select("u", F.least("l", "m").alias("l"), F.col("l").alias("was"))
        own = low.select(F.col("u").alias("l"), F.col("l").alias("further"))
        now = written(low.join(own, "l", "left").select("u", F.least("l", "further").alias("l"), "was"), "labels")
        if now.where("l != was").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("l").alias("component"))
        labels = now.select("u", "l")
    raise RuntimeError("components did not settle")
