"""How surprising a step is over all entities and features: common part, energy, participation and agreement along edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .panel import ratio

SURPRISE = ("common_energy", "total_energy", "node_median", "node_q75", "participation", "coherence", "edge_agreement", "systemic_energy")


def standardised(long: DataFrame, scales: DataFrame, clip: float = 8.0) -> DataFrame:
    """(step, node, feature, z) of (step, node, feature, residual) and (feature, center, scale): scaled and clipped; nulls, NaN and features without a positive scale take no part.
    One row a feature is broadcast."""
    s = scales.where("scale > 0").select("feature", "center", "scale")
    z = (F.col("residual") - F.col("center")) / F.col("scale")
    z = F.least(F.greatest(z, F.lit(-clip)), F.lit(clip))
    return long.join(F.broadcast(s), "feature").where("residual is not null and not isnan(residual)").select("step", "node", "feature", z.alias("z"))


def residual_surprise(z: DataFrame, edges: DataFrame | None = None, least: int = 20, threshold: float = 1.0) -> DataFrame:
    """One row a step with the values of SURPRISE; z: (step, node, feature, z), one row each and read several times, so a written table.

    A feature counts in a step where ``least`` nodes have it, a node where it has a quarter of these features; steps with fewer than ``least`` such nodes have no row.
    The common part is each feature's median over all nodes. edge_agreement: a node's side is the sign of its mean z along the signs of the common part; the
    share of agreeing less disagreeing edges (src, dst, weight), weighted by size and turned by the sign of the weight where any weight is not nil; 0 where no feature has a common part,
    null without edges between nodes of the step."""
    f = z.groupBy("step", "feature").agg(F.count("*").alias("_n"), F.percentile("z", F.lit(0.5)).alias("common")).where(F.col("_n") >= least).drop("_n")
    counts = f.groupBy("step").agg(F.count("*").alias("_features"), F.sqrt(F.avg(F.col("common") * F.col("common"))).alias("common_energy"), F.max((F.abs("common") > 1e-8).cast("int")).alias("_useful"))
    # features are few a step: they travel as one map beside it
    known = f.groupBy("step").agg(F.map_from_entries(F.collect_list(F.struct("feature", "common"))).alias("_common")).join(counts, "step")
    x = z.join(known, "step").withColumn("_c", F.try_element_at("_common", "feature")).where("_c is not null")
    square = F.col("z") * F.col("z")
    along = F.when(F.abs("_c") > 1e-8, F.col("z") * F.signum("_c"))
    nodes = x.groupBy("step", "node").agg(F.first("_features").alias("_features"), F.first("common_energy").alias("common_energy"), F.first("_useful").alias("_useful"), F.count("*").alias("_n"), F.sum(square).alias("_sum"), F.avg(along).alias("_along"))
    full = F.col("_n") >= F.greatest(F.lit(1), F.ceil(F.col("_features") * 0.25))
    energy = F.when(full, F.sqrt(F.col("_sum") / F.col("_n")))
    s = nodes.withColumn("_energy", energy).groupBy("step").agg(
        F.count("_energy").alias("_full"), F.first("common_energy").alias("common_energy"), F.first("_useful").alias("_useful"),
        F.sqrt(ratio(F.sum(F.when(full, F.col("_sum"))), F.sum(F.when(full, F.col("_n"))))).alias("total_energy"),
        F.percentile("_energy", F.lit(0.5)).alias("node_median"), F.percentile("_energy", F.lit(0.75)).alias("node_q75"),
        F.avg((F.col("_energy") >= threshold).cast("int")).alias("participation"),
    ).where(F.col("_full") >= least)
    if edges is None:
        s = s.withColumn("_agreement", F.lit(None).cast("double"))
    else:
        s = s.join(agreement(nodes.select("step", "node", "_along"), edges), "step", "left")
    coherence = F.when(F.col("total_energy") > 1e-12, F.least(F.lit(1.0), F.col("common_energy") / F.col("total_energy"))).otherwise(0.0)
    systemic = F.sqrt(F.col("common_energy") * F.col("common_energy") + F.col("node_median") * F.col("node_median") * F.col("participation"))
    edge = F.when(F.col("_useful") == 0, F.lit(0.0 if edges is not None else None)).otherwise(F.col("_agreement"))
    return s.select("step", "common_energy", "total_energy", "node_median", "node_q75", "participation", coherence.alias("coherence"), edge.cast("double").alias("edge_agreement"), systemic.alias("systemic_energy"))


def agreement(sides: DataFrame, edges: DataFrame) -> DataFrame:
    """(step, _agreement) of (step, node, _along) over edges (src, dst, weight): both joins by shuffle, one row an edge and step."""
    sides = sides.where("_along is not null")
    a = sides.select("step", F.col("node").alias("src"), F.signum("_along").alias("_a"))
    b = sides.select("step", F.col("node").alias("dst"), F.signum("_along").alias("_b"))
    e = edges.select("src", "dst", F.col("weight").cast("double").alias("weight")).join(a, "src").join(b, ["step", "dst"])
    weight = F.when(F.isnan("weight") | (F.abs("weight") == float("inf")) | (F.col("weight") == 0), F.lit(None)).otherwise(F.col("weight"))
    weighed = ratio(F.sum(F.col("_a") * F.col("_b") * weight), F.sum(F.abs(weight)))
    return e.groupBy("step").agg(F.coalesce(weighed, F.avg(F.col("_a") * F.col("_b"))).alias("_agreement"))
