"""Row-set comparison, duplicates, samples and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_diff(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Keys of both sides with ``side``: both, left or right."""
    a, b = left.select(*key).distinct().withColumn("_a", F.lit(True)), right.select(*key).distinct().withColumn("_b", F.lit(True))
    side = F.when(F.col("_b").isNull(), "left").when(F.col("_a").isNull(), "right").otherwise("both")
    return a.join(b, key, "full_outer").select(*key, side.alias("side"))


def keep_one(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by an explicit order."""
    return df.withColumn("_i", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_i = 1").drop("_i")


def conflicting(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys whose rows differ in another column."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.count("*").alias("rows"), F.count_distinct(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in rest])).alias("versions")).where("versions > 1")


def hash_sample(df: DataFrame, identity: str, strata: list[str], n: int, seed: str) -> DataFrame:
    """The n rows of each stratum with the least sha256 of seed and identity."""
    digest = F.sha2(F.concat_ws("|", F.lit(seed), F.col(identity).cast("string")), 256)
    w = Window.partitionBy(*strata).orderBy("digest", identity)
    return df.withColumn("digest", digest).withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= n).drop("_i")


def with_reason(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """df with ``reason``: the first rule that holds, or "accepted"."""
    out = None
    for name, rule in rules:
        c = F.coalesce(rule, F.lit(False))
        out = F.when(c, name) if out is None else out.when(c, name)
    return df.withColumn("reason", out.otherwise("accepted") if out is not None else F.lit("accepted"))
