"""Causal price indexes from raw and vendor-adjusted bars, corporate actions, and extension by a later release.

A vendor rescales all earlier adjusted prices at every corporate action, so a level from its last release knows the future. Adjacent adjusted
returns do not: their product from the first raw close on is the causal index, which is raw_0 * adjusted_t / adjusted_0 in closed form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import by
from .panel import ratio

PRICES = ("open", "high", "low", "close")


def adjustment_factor() -> Column:
    """Median of the four ratios of adjusted to raw price where both are positive."""
    each = [F.when((F.col(f"adjusted_{c}") > 0) & (F.col(c) > 0), F.col(f"adjusted_{c}") / F.col(c)) for c in PRICES]
    v = F.array_sort(F.array_compact(F.array(*each)))
    n = F.size(v)
    at = lambda i: F.get(v, i)
    return F.when(n > 0, (at(F.floor((n - 1) / 2).cast("int")) + at(F.floor(n / 2).cast("int"))) / 2)


def causal_bars(bars: DataFrame, jump: float = 0.02) -> DataFrame:
    """bars (ticker, date, open, high, low, close, volume, adjusted_open, .. adjusted_close, adjusted_volume) as causal ones.

    Prices become raw price times ``scale``, volume is divided by it, and raw_* and adjusted_* keep what was given; with factor (carried forward, then
    back), volume_factor, raw_return, causal_return and action, where the factor jumped by ``jump``. A raw or adjusted close that is not positive is an error."""
    w, first = by(), by().rowsBetween(Window.unboundedPreceding, 0)
    good = F.coalesce((F.col("close") > 0) & (F.col("adjusted_close") > 0), F.lit(False))
    checked = bars.where(F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("no positive close: "), F.col("ticker").cast("string"))).cast("boolean")))
    f = checked.withColumn("_f", adjustment_factor())
    back = by().rowsBetween(0, Window.unboundedFollowing)
    f = f.withColumn("factor", F.coalesce(F.last("_f", ignorenulls=True).over(first), F.first("_f", ignorenulls=True).over(back))).drop("_f")
    change = lambda c: F.coalesce(F.col(c) / F.lag(c).over(w) - 1, F.lit(0.0))
    f = f.withColumns(
        {
            "volume_factor": F.when((F.col("adjusted_volume") > 0) & (F.col("volume") > 0), F.col("volume") / F.col("adjusted_volume")),
            "raw_return": change("close"),
            "causal_return": change("adjusted_close"),
            "action": F.coalesce(F.abs(F.col("factor") / F.lag("factor").over(w) - 1) >= jump, F.lit(False)),
            "scale": F.first("close").over(first) * F.col("adjusted_close") / F.first("adjusted_close").over(first) / F.col("close"),
        }
    )
    raw = {f"raw_{c}": F.col(c) for c in (*PRICES, "volume")}
    f = f.withColumns(raw)
    return f.withColumns({c: F.col(f"raw_{c}") * F.col("scale") for c in PRICES} | {"volume": F.col("raw_volume") / F.col("scale")})


def action_events(causal: DataFrame) -> DataFrame:
    """One row a corporate action: factors before and after, their ratio, whether the volume's factor agrees within 2 %, and both returns."""
    w = by()
    e = causal.withColumn("factor_before", F.lag("factor").over(w)).where("action")
    agrees = F.coalesce(F.abs(F.col("volume_factor") / F.col("factor") - 1) <= 0.02, F.lit(False))
    return e.select("ticker", "date", "factor_before", F.col("factor").alias("factor_after"), ratio(F.col("factor_before"), F.col("factor")).alias("action_ratio"), agrees.alias("corroborated"), "raw_return", "causal_return", F.col("scale").alias("scale_after"))


def extended(base: DataFrame, increment: DataFrame, jump: float = 0.02) -> DataFrame:
    """base (rows of ``causal_bars``) with the sessions of a later release behind its last ones, on the base's scale.

    The increment holds each entity's bars from the base's last session (the bridge) on, with the vendor's adjustment of that day. Its own causal bars
    are multiplied by the ratio of both scales at the bridge. The bridge's raw values must be there and equal, or the job fails; entities that only one
    side holds keep their rows."""
    columns = base.columns
    raw = [f"raw_{c}" for c in (*PRICES, "volume")]
    bridge = base.groupBy("ticker").agg(F.max_by(F.struct("date", "scale", *raw), "date").alias("_b")).select("ticker", F.col("_b.date").alias("_day"), F.col("_b.scale").alias("_scale"), *[F.col(f"_b.{c}").alias(f"_{c}") for c in raw])  # one row an entity
    recent = causal_bars(increment, jump).join(bridge, "ticker", "left").where(F.col("_day").isNull() | (F.col("date") >= F.col("_day")))
    whole = Window.partitionBy("ticker")
    near = reduce(lambda a, b: a & b, [F.abs(F.col(c) - F.col(f"_{c}")) <= 1e-6 + 1e-9 * F.abs(F.col(c)) for c in raw])
    meets = F.max((F.col("_day").isNull() | ((F.col("date") == F.col("_day")) & F.coalesce(near, F.lit(False)))).cast("int")).over(whole)
    q = recent.withColumns({"_meets": meets, "_ratio": F.coalesce(F.max(F.when(F.col("date") == F.col("_day"), F.col("_scale") / F.col("scale"))).over(whole), F.lit(1.0))})
    q = q.where(F.when(F.col("_meets") == 1, F.col("_day").isNull() | (F.col("date") > F.col("_day"))).otherwise(F.raise_error(F.concat(F.lit("bridge row is missing or differs: "), F.col("ticker").cast("string"))).cast("boolean")))
    moved = q.withColumns({c: F.col(c) * F.col("_ratio") for c in (*PRICES, "scale")} | {"volume": F.col("volume") / F.col("_ratio")})
    return base.unionByName(moved.select(*columns))
