"""Two vendors' views of the same bars as one masked feature panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import by, full, prior_rows


def same_sessions(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both sides (a's columns, b's with ``other_``), which must have the same keys, or the job fails."""
    left = a.select(*key, *[c for c in a.columns if c not in key], F.lit(True).alias("_a"))
    right = b.select(*key, *[F.col(c).alias(f"other_{c}") for c in b.columns if c not in key], F.lit(True).alias("_b"))
    j = left.join(right, key, "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    fault = F.raise_error(F.concat(F.lit("sessions of the sources differ: "), F.concat_ws(",", *[F.col(k).cast("string") for k in key]))).cast("boolean")
    return j.where(F.when(both, True).otherwise(fault)).drop("_a", "_b")


def consensus(a: DataFrame, b: DataFrame, close_tolerance: float = 0.001, volume_tolerance: float = 0.05, lookback: int = 20, least: int = 10) -> DataFrame:
    """Of (ticker, date, close, volume) and (ticker, date, close, adjusted_close, volume): differences and which values both sources bear out.

    A return counts if both closes of it agree; log volume is held against the median of the agreed ones of ``lookback`` sessions before, ``least`` of them at least."""
    j = same_sessions(a.select("ticker", "date", "close", "volume"), b.select("ticker", "date", "close", "adjusted_close", "volume"), ["ticker", "date"])
    far = lambda x, y, low: F.abs(F.col(x) - F.col(y)) / F.greatest(F.abs(y), F.lit(low))
    j = j.withColumns({"close_difference": far("close", "other_close", 2.0**-52), "volume_difference": far("volume", "other_volume", 1.0)})
    j = j.withColumns({"close_valid": F.coalesce(F.col("close_difference") <= close_tolerance, F.lit(False)), "volume_valid": F.coalesce(F.col("volume_difference") <= volume_tolerance, F.lit(False))})
    step = F.log(F.col("other_adjusted_close")) - F.lag(F.log(F.col("other_adjusted_close"))).over(by())
    ok = F.col("close_valid") & F.coalesce(F.lag("close_valid").over(by()), F.lit(False))
    j = j.withColumns({"log_return": F.when(ok, step), "_v": F.when(F.col("volume_valid"), F.log1p("other_volume"))})
    past = prior_rows(lookback)
    j = j.withColumns({"volume_baseline": full(F.percentile("_v", 0.5), F.col("_v"), past, least), "volume_observations": F.count("_v").over(past)})
    return j.withColumns({"volume_shock": F.col("_v") - F.col("volume_baseline"), "return_valid": F.col("log_return").isNotNull()}).withColumn("volume_feature_valid", F.col("volume_shock").isNotNull()).drop("_v")
