"""Graph edges between entities and what flows along them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from . import gram
from .asof import asof_forward


def correlation_edges(panel: DataFrame, x: str, rows: int, least: float, top: int) -> DataFrame:
    """step, src, dst, weight: correlation of x over the last ``rows`` sessions up to the last
    one, null as 0; the ``top`` strongest of each src (ties: larger dst) of at least ``least``."""
    p = written(panel.select("ticker", "date", x), "panel")
    step = p.agg(F.max("date").alias("step"))  # one row
    e = gram.correlation_edges(gram.histories(p, x, rows), top, least)
    return e.join(F.broadcast(step), F.lit(True)).select("step", "src", "dst", "weight")


def strongest(edges: DataFrame, top: int) -> DataFrame:
    w = Window.partitionBy("step", "src").orderBy(F.desc(F.abs("weight")), F.desc("dst"))
    return edges.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= top).drop("_i")


def neighbour_mean(edges: DataFrame, state: DataFrame, x: str) -> DataFrame:
    """Weighted mean of x over the sources of each dst; the divisor is 1 at least."""
    j = edges.join(state.select(F.col("ticker").alias("src"), F.col(x).alias("_x")), "src").where("_x is not null")
    return j.groupBy("step", "dst").agg((F.sum(F.col("weight") * F.col("_x")) / F.greatest(F.sum(F.abs("weight")), F.lit(1.0))).alias("neighbour_mean"))


def prefix_members(entities: DataFrame, key: str, code: str, length: int) -> DataFrame:
    """Each entity with its group of equal code prefix and the number of its peers: the clique's
    edges without listing every pair."""
    g = F.substring(code, 1, length)
    return entities.select(F.col(key).alias("entity"), g.alias("prefix")).where("prefix is not null").withColumn("peers", F.count("*").over(Window.partitionBy("prefix")) - 1)


def ownership_stakes(filings: DataFrame, sessions: DataFrame, least: float = 0.01) -> DataFrame:
    """(holder, target, ratio, since, until): the stake known from each session on, until the one before ``until`` (null: open).

    filings: (holder, target, date, ratio in per cent, text or number). One counts from the first session at or after its date until a newer one; of one
    session the latest date counts, then the greatest ratio. Unreadable and non-positive ratios and an entity's stake in itself are left out, ratios are cut at
    100, and pairs that never reach ``least`` have no rows. Days are looked up in the calendar, one row each."""
    ratio = F.regexp_replace(F.col("ratio").cast("string"), ",", "").try_cast("double")
    f = filings.select("holder", "target", F.col("date").cast("date").alias("date"), ratio.alias("ratio")).where("holder != target and ratio > 0 and ratio < double('inf') and date is not null")
    f = f.withColumn("ratio", F.least(F.col("ratio"), F.lit(100.0)) / 100)
    days = f.select("date").distinct().withColumn("_one", F.lit(1))
    calendar = sessions.select(F.col("date").alias("session")).distinct().withColumn("_one", F.lit(1))
    at = asof_forward(days, calendar, ["_one"], "date", "session", prefix="").select("date", "session")  # one row a day
    s = f.join(F.broadcast(at), "date").where("session is not null").groupBy("holder", "target", "session").agg(F.max(F.struct("date", "ratio")).alias("_l"))
    pair = Window.partitionBy("holder", "target")
    s = s.select("holder", "target", "session", F.col("_l.ratio").alias("ratio")).withColumns({"_most": F.max("ratio").over(pair), "until": F.lead("session").over(pair.orderBy("session"))})
    return s.where(F.col("_most") >= least).select("holder", "target", "ratio", F.col("session").alias("since"), "until")


def ownership_edges(stakes: DataFrame, on, scale: float = 1.0) -> DataFrame:
    """(src, dst, weight) of the stakes known on a session, in both directions: from target to holder and back."""
    active = stakes.where((F.col("since") <= on) & (F.col("until").isNull() | (F.col("until") > on))).withColumn("weight", F.col("ratio") * scale)
    up = active.select(F.col("target").alias("src"), F.col("holder").alias("dst"), "weight")
    return up.union(active.select(F.col("holder").alias("src"), F.col("target").alias("dst"), "weight"))


def edge_union(*parts: DataFrame) -> DataFrame:
    """All edges of several kinds, weights rounded to 1e-4 (half to even), in the order src, dst, weight. Edges of equal ends stay apart."""
    u = reduce(lambda a, b: a.unionByName(b), [p.select("src", "dst", "weight") for p in parts])
    return u.withColumn("weight", F.bround("weight", 4)).orderBy("src", "dst", "weight")
