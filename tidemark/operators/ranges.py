"""Running sums over long groups: rows are dealt to tasks by ranges of group and order, so that a group of any length is summed by many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def running_sums(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, str]) -> DataFrame:
    """df with, for each name, the sum of a column over the group's rows up to this one by ``order``, which must not leave ties.

    Each task sums its own range; what lies before a range in its group is one row a task and group."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = written(df.repartitionByRange(n, *group, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    per = r.groupBy(*group, "_part").agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    w = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select(*group, "_part", *[F.coalesce(F.sum(f"_{k}").over(w), F.lit(0)).alias(f"_{k}") for k in sums])
    own = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = r.withColumns({k: F.sum(c).over(own) for k, c in sums.items()})
    return inner.join(before, [*group, "_part"]).withColumns({k: F.col(k) + F.col(f"_{k}") for k in sums}).drop("_part", *[f"_{k}" for k in sums])
