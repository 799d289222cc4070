"""Entity x session panels: bars, calendar, causal price features, cross-sections, targets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .frames import by, full, last_rows


def finite(x: Column) -> Column:
    """NaN and infinities as null: the one conversion at the scan."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def bars(ticks: DataFrame, entity: str, session: Column, price: Column, volume: Column, order: list[str]) -> DataFrame:
    """One bar per entity and session: first, highest, lowest and last price by ``order``, volume.

    A single order column of fixed width (see ``order_key``) is aggregated by hash; several, as a struct, by sorting."""
    o = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    t = ticks.select(F.col(entity).alias("ticker"), session.alias("date"), finite(price).alias("p"), volume.alias("v"), o.alias("o"))
    return t.groupBy("ticker", "date").agg(
        F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"), F.sum("v").alias("volume")
    )


def order_key(day: Column, key: Column, line: Column) -> Column:
    """Day, key and line as one long that sorts like the three: 41 bits of the key and 7 of the line. A key or line beyond them, or a day before 1970, is an error."""
    fits = (F.unix_date(day) >= 0) & key.between(0, (1 << 41) - 1) & line.between(0, 127)
    packed = (F.unix_date(day).cast("long") * (1 << 41) + key) * 128 + line
    return F.when(fits, packed).otherwise(F.raise_error(F.lit("order key out of range")).cast("long"))


def observed(open_: Column, high: Column, low: Column, close: Column, volume: Column) -> Column:
    """A bar is observed if all prices are positive and it is not flat without volume."""
    flat = (open_ == high) & (high == low) & (low == close) & (volume <= 0)
    return F.coalesce((F.least(open_, high, low, close) > 0) & ~flat, F.lit(False))


def densify(b: DataFrame) -> DataFrame:
    """Every entity on every session of the calendar; closes are carried, absent bars are unobserved.

    The bars are written once, since grid and calendar are read from them too. The calendar is an array of sessions in one row, so that the grid is a
    local explode."""
    b = written(b, "bars")
    ok = observed(*(F.col(c) for c in ("open", "high", "low", "close", "volume")))
    marked = b.withColumn("observed", ok)
    for c in ("open", "high", "low", "close"):
        marked = marked.withColumn(c, F.when(F.col("observed"), F.col(c)))
    calendar = marked.agg(F.array_sort(F.collect_set("date")).alias("dates"))
    grid = marked.select("ticker").distinct().join(F.broadcast(calendar), F.lit(True)).select("ticker", F.explode("dates").alias("date"))
    j = grid.join(marked, ["ticker", "date"], "left")
    filled = F.last("close", ignorenulls=True).over(by().rowsBetween(Window.unboundedPreceding, 0))
    return j.select(
        "ticker", "date", "open", "high", "low", "close", F.coalesce("volume", F.lit(0.0)).alias("volume"),
        F.coalesce("observed", F.lit(False)).alias("observed"), filled.alias("execution_close"),
    )


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def pearson(a: Column | str, b: Column | str, over=None) -> Column:
    """Correlation of two columns that are null together, null where one does not vary: the built-in one divides by zero there."""
    f = (lambda x: x) if over is None else (lambda x: x.over(over))
    return F.try_divide(f(F.covar_pop(a, b)), f(F.stddev_pop(a)) * f(F.stddev_pop(b)))


def change(x: str, k: int) -> Column:
    return ratio(F.col(x), F.lag(x, k).over(by())) - 1


def zscore(x: str, n: int) -> Column:
    f = last_rows(n)
    return F.when(F.count(x).over(f) >= n, ratio(F.col(x) - F.avg(x).over(f), F.stddev_samp(x).over(f)))


RETURNS = (1, 2, 3, 5, 10, 20, 60, 120)
AVERAGES = (5, 10, 20, 60, 120)
VOLATILITIES = (5, 10, 20, 60)


def price_features(panel: DataFrame) -> DataFrame:
    """Rolling features of each entity's own rows; each needs its whole window."""
    c = F.col
    out = panel.withColumns({f"return_{k}d": change("close", k) for k in RETURNS})
    out = out.withColumns(
        {
            "value": c("close") * c("volume"),
            "volume_log": F.log1p("volume"),
            "value_log": F.log1p(c("close") * c("volume")),
            "range_pct": ratio(c("high") - c("low"), c("close")),
            "gap_open": ratio(c("open"), F.lag("close", 1).over(by())) - 1,
            "intraday_return": ratio(c("close"), c("open")) - 1,
        }
    )
    f = last_rows
    out = out.withColumns(
        {f"ma{n}_gap": ratio(c("close"), full(F.avg("close"), c("close"), f(n), n)) - 1 for n in AVERAGES}
        | {f"volatility_{n}d": full(F.stddev_samp("return_1d"), c("return_1d"), f(n), n) for n in VOLATILITIES}
        | {
            "downside_volatility_20d": full(F.stddev_samp(F.when(c("return_1d") < 0, c("return_1d")).otherwise(0.0)), F.lit(1), f(20), 20),
            "volume_z20": zscore("volume_log", 20),
            "volume_z60": zscore("volume_log", 60),
            "value_z20": zscore("value_log", 20),
            "value_z60": zscore("value_log", 60),
            "range_z20": zscore("range_pct", 20),
            "value_ma20_log": F.log1p(full(F.avg("value"), c("value"), f(20), 20)),
            "amihud_20d": full(F.avg(ratio(F.abs(c("return_1d")), c("value"))), ratio(F.abs(c("return_1d")), c("value")), f(20), 20),
            "drawdown_20d": ratio(c("close"), full(F.max("close"), c("close"), f(20), 20)) - 1,
            "drawdown_120d": ratio(c("close"), full(F.max("close"), c("close"), f(120), 120)) - 1,
            "breakout_20d": ratio(c("close"), full(F.min("close"), c("close"), f(20), 20)) - 1,
            "breakout_120d": ratio(c("close"), full(F.min("close"), c("close"), f(120), 120)) - 1,
            "range_position_120d": ratio(
                c("close") - full(F.min("close"), c("close"), f(120), 120), full(F.max("close"), c("close"), f(120), 120) - full(F.min("close"), c("close"), f(120), 120)
            ),
        }
    )
    return out.withColumn("volatility_ratio_20_60", ratio(c("volatility_20d"), c("volatility_60d")))


def average_rank(x: str, over: str = "date") -> Column:
    """Rank with ties at their average, from 1."""
    return F.rank().over(Window.partitionBy(over).orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(over, x)) - 1) / 2


def cross_section(panel: DataFrame, x: str, least: int = 3) -> DataFrame:
    """Centred rank (-0.5..0.5) and z-score by population deviation of x within its date."""
    d = Window.partitionBy("date")
    some = panel.where(F.col(x).isNotNull())
    z = F.when((F.count(x).over(d) >= least) & (F.stddev_pop(x).over(d) > 0), (F.col(x) - F.avg(x).over(d)) / F.stddev_pop(x).over(d))
    return some.withColumns({"cs_rank": average_rank(x) / F.count(x).over(d) - 0.5, "cs_z": z})


def with_market(panel: DataFrame, x: str = "return_1d") -> DataFrame:
    """The mean of x over the entities observed on the date, and x less it."""
    m = F.avg(x).over(Window.partitionBy("date"))
    return panel.withColumns({"market": m, "relative": F.col(x) - m})


def beta(panel: DataFrame, n: int = 60) -> DataFrame:
    """Slope and correlation to the market over n complete pairs."""
    f, pair = last_rows(n), F.col("return_1d").isNotNull() & F.col("market").isNotNull()
    x, y = F.when(pair, F.col("market")), F.when(pair, F.col("return_1d"))
    return panel.withColumns(
        {
            "beta": F.when(F.count(y).over(f) >= n, ratio(F.covar_samp(y, x).over(f), F.var_samp("market").over(f))),
            "corr": F.when(F.count(y).over(f) >= n, pearson(y, x, f)),
        }
    )


def forward_targets(panel: DataFrame, h: int) -> DataFrame:
    """From the next open to the close h rows on: return, best and worst close, realised
    volatility. Every row of the path must have a close."""
    w = by()
    entry = F.lead("open", 1).over(w)
    path = w.rowsBetween(1, h)
    whole = (F.count("close").over(path) == h) & (entry > 0)
    log_step = F.log(F.col("close") / F.lag("close", 1).over(w))
    p = panel.withColumn("_step", log_step)
    return p.withColumns(
        {
            "target_return": F.when(whole, F.lead("close", h).over(w) / entry - 1),
            "target_best": F.when(whole, F.max("close").over(path) / entry - 1),
            "target_worst": F.when(whole, F.min("close").over(path) / entry - 1),
            "target_volatility": F.when(whole & (F.count("_step").over(path) == h), F.stddev_pop("_step").over(path)),
        }
    ).drop("_step")


def robust_cross_section(panel: DataFrame, x: str, least: int = 4) -> DataFrame:
    """Location, spread and breadth of each date: two passes, the second around the median."""
    some = panel.where(F.col(x).isNotNull())
    mid = F.percentile(x, 0.5).over(Window.partitionBy("date"))
    return (
        some.withColumn("_mid", mid)
        .groupBy("date")
        .agg(
            F.count("*").alias("n"),
            F.avg(x).alias("mean"),
            F.avg(F.abs(x)).alias("mean_abs"),
            F.sqrt(F.avg(F.col(x) * F.col(x))).alias("rms"),
            F.stddev_pop(x).alias("std"),
            F.max("_mid").alias("median"),
            F.percentile(x, 0.75).alias("q75"),
            (F.percentile(F.abs(F.col(x) - F.col("_mid")), 0.5) * 1.4826).alias("mad"),
            F.avg(F.when(F.col(x) > 0, 1.0).otherwise(0.0)).alias("breadth"),
            F.try_divide(F.abs(F.sum(x)), F.sum(F.abs(x))).alias("coherence"),
            F.try_divide(F.sum(F.pow(F.abs(F.col(x)), 2)), F.pow(F.sum(F.abs(x)), 2)).alias("concentration"),
        )
        .where(F.col("n") >= least)
    )


def scaled(panel: DataFrame, columns: list[str], train_end) -> DataFrame:
    """Columns less their mean, over their population deviation, of the rows up to train_end;
    deviations under 1e-6 count as 1 and null becomes 0."""
    fit = panel.where(F.col("date") <= F.lit(train_end)).agg(
        *[F.avg(c).alias(f"{c}_m") for c in columns], *[F.when(F.stddev_pop(c) < 1e-6, 1.0).otherwise(F.stddev_pop(c)).alias(f"{c}_s") for c in columns]
    )
    j = panel.join(F.broadcast(fit), F.lit(True))  # one row
    return reduce(lambda d, c: d.withColumn(c, F.coalesce((F.col(c) - F.col(f"{c}_m")) / F.col(f"{c}_s"), F.lit(0.0))), columns, j).select(panel.columns)
