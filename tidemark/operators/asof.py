"""Point-in-time joins by ordered scans: the two sides are united, sorted by entity and time,
and a window carries the last (or next) row of the other side. One shuffle, no range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _united(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, rank: int) -> DataFrame:
    payload = F.struct(*[c for c in right.columns if c not in by])
    r = right.select(*by, F.col(right_at).alias("_at"), F.lit(rank).alias("_rank"), payload.alias("_r"))
    typed = r.schema["_r"].dataType
    left_row = left.select(*by, F.col(left_at).alias("_at"), F.lit(1).alias("_rank"), F.lit(None).cast(typed).alias("_r"), F.struct(*left.columns).alias("_l"))
    return r.withColumn("_l", F.lit(None).cast(left_row.schema["_l"].dataType)).select(*by, "_at", "_rank", "_r", "_l").unionByName(left_row)


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, strict: bool = False, prefix: str = "r_", tie: list[str] | None = None) -> DataFrame:
    """left with the last right row at or before (strict: before) its time, prefixed; null if none.
    tie: right columns that order rows of equal time, the greatest last."""
    u = _united(left, right, by, left_at, right_at, 2 if strict else 0)
    order: list[Column] = [F.col("_at"), F.col("_rank"), *[F.col(f"_r.{c}") for c in tie or []]]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    got = u.withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_l is not null")
    return got.select("_l.*", *[F.col(f"_m.{c}").alias(prefix + c) for c in right.columns if c not in by])


def asof_forward(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, strict: bool = False, prefix: str = "r_", tie: list[str] | None = None) -> DataFrame:
    """left with the first right row at or after (strict: after) its time."""
    u = _united(left, right, by, left_at, right_at, 0 if strict else 2)
    order = [F.col("_at"), F.col("_rank"), *[F.col(f"_r.{c}") for c in tie or []]]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    got = u.withColumn("_m", F.first("_r", ignorenulls=True).over(w)).where("_l is not null")
    return got.select("_l.*", *[F.col(f"_m.{c}").alias(prefix + c) for c in right.columns if c not in by])


def within_intervals(points: DataFrame, intervals: DataFrame, by: list[str], at: str, start: str, end: str) -> DataFrame:
    """points with ``covered``: whether an interval [start, end) of the same entity holds the time.

    Starts and ends become +1 and -1 in one ordered scan; a point is covered while the running sum is positive."""
    marks = intervals.select(*by, F.explode(F.array(F.struct(F.col(start).alias("_at"), F.lit(1).alias("_d")), F.struct(F.col(end).alias("_at"), F.lit(-1).alias("_d")))).alias("x"))
    marks = marks.select(*by, "x._at", "x._d")
    rows = points.select(*by, F.col(at).alias("_at"), F.lit(0).alias("_d"), F.struct(*points.columns).alias("_p"))
    u = marks.withColumn("_p", F.lit(None).cast(rows.schema["_p"].dataType)).unionByName(rows)
    # at one time all marks come before points
    w = Window.partitionBy(*by).orderBy("_at", F.col("_p").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return u.withColumn("_n", F.sum("_d").over(w)).where("_p is not null").select("_p.*", (F.col("_n") > 0).alias("covered"))
