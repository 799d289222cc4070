"""Screens, labels and small summaries of a panel: what may be traded, which session is complete, bins, lags, sensitivities."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import by, last_rows
from .panel import ratio


def tradeable(panel: DataFrame, score: str, price: str, low: float, high: float, n: int, known: str = "observed") -> DataFrame:
    """The n best scores of each date among rows whose market state is known and whose price is positive and within low..high; ties: the larger ticker first."""
    ok = panel.where(F.col(known) & F.col(score).isNotNull() & (F.col(price) > 0) & F.col(price).between(low, high))
    return ok.withColumn("place", F.row_number().over(Window.partitionBy("date").orderBy(F.desc(score), F.desc("ticker")))).where(F.col("place") <= n)


def moved(panel: DataFrame, x: str, least: float) -> DataFrame:
    """Rows whose x differs from the row before of the entity and is at least ``least``: near halts are left out."""
    return panel.withColumn("_before", F.lag(x).over(by())).where((F.col(x) != F.col("_before")) & (F.col(x) >= least)).drop("_before")


def latest_complete_session(panel: DataFrame, x: str = "return_1d", price: str = "close", share: float = 0.9, lookback: int = 20) -> DataFrame:
    """One row, the newest session that is no partial update: date, step (from 0), observed, reference, threshold, coverage_ratio, panel_latest_date, panel_latest_observed.

    A session's coverage counts entities with x and a positive price; the reference is the greatest of the panel's last ``lookback`` sessions, and
    the threshold its ``share``, rounded up, 1 at least. No row if no session reaches it."""
    seen = F.count_if(F.col(x).isNotNull() & F.coalesce(F.col(price) > 0, F.lit(False)))
    per = panel.groupBy("date").agg(seen.alias("observed"))  # one row a session from here on
    w = Window.orderBy("date")
    per = per.withColumns({"step": F.row_number().over(w) - 1, "_back": F.row_number().over(Window.orderBy(F.desc("date")))})
    ends = per.agg(F.max(F.when(F.col("_back") <= lookback, F.col("observed"))).alias("reference"), F.max("date").alias("panel_latest_date"), F.max_by("observed", "date").alias("panel_latest_observed"))
    j = per.join(F.broadcast(ends), F.lit(True)).withColumn("threshold", F.greatest(F.lit(1), F.ceil(F.col("reference") * share)))
    last = j.where(F.col("observed") >= F.col("threshold")).orderBy(F.desc("date")).limit(1)
    return last.withColumn("coverage_ratio", F.col("observed") / F.greatest(F.col("reference"), F.lit(1))).drop("_back")


def enveloped(b: DataFrame, largest: float = 0.01, share: float = 0.01, fail: bool = True, key: str = "ticker") -> DataFrame:
    """Bars with high and low moved out to the greatest and least of the four prices; vendor_high and vendor_low keep what was given.

    repaired marks the bars that moved, magnitude is the move over the close. An entity fails as a whole if a price of its is not positive, if a magnitude is
    above ``largest`` or if more than ``share`` of its bars move: the job ends with an error, or without ``fail`` its rows have ``fault``."""
    prices = ("open", "high", "low", "close")
    top, low = F.greatest(*prices), F.least(*prices)
    up, down = F.greatest(top - F.col("high"), F.lit(0.0)), F.greatest(F.col("low") - low, F.lit(0.0))
    whole = reduce(lambda x, y: x & y, [F.coalesce(F.col(c) > 0, F.lit(False)) for c in prices])
    m = b.withColumns({"_top": top, "_low": low, "repaired": F.coalesce((up > 0) | (down > 0), F.lit(False)), "magnitude": F.greatest(up, down) / F.greatest(F.abs("close"), F.lit(2.0**-52)), "_whole": whole})
    w = Window.partitionBy(key)
    fault = (F.min("_whole").over(w) == F.lit(False)) | (F.max("magnitude").over(w) > largest) | (F.avg(F.col("repaired").cast("int")).over(w) > share)
    m = m.withColumn("fault", F.coalesce(fault, F.lit(True)))
    if fail:
        m = m.where(F.when(F.col("fault"), F.raise_error(F.concat(F.lit("envelope repair beyond its limits: "), F.col(key).cast("string"))).cast("boolean")).otherwise(True))
    return m.withColumns({"vendor_high": F.col("high"), "vendor_low": F.col("low"), "high": F.col("_top"), "low": F.col("_low")}).drop("_top", "_low", "_whole")


def rank_bins(panel: DataFrame, x: str, bins: int, group: str = "date") -> DataFrame:
    """bin 0..bins-1 by rank of x within its group, rank * bins div n; groups of fewer values than bins are left out."""
    w = Window.partitionBy(group)
    some = panel.where(F.col(x).isNotNull()).withColumn("_n", F.count("*").over(w)).where(F.col("_n") >= bins)
    i = F.row_number().over(w.orderBy(x, "ticker")) - 1
    return some.withColumn("bin", F.least(F.floor(i * bins / F.col("_n")), F.lit(bins - 1))).drop("_n")


def lags(panel: DataFrame, x: str, n: int) -> DataFrame:
    return panel.withColumns({f"{x}_lag{k}": F.lag(x, k).over(by()) for k in range(1, n + 1)})


def train_scaled(panel: DataFrame, columns: list[str], train_end: Column, least: int = 100, limit: float = 5.0) -> DataFrame:
    """Columns less their mean, over their population deviation, of the rows up to train_end, within +-limit; absent values become 0 and ``<column>_known`` says so.

    A column with fewer than ``least`` training values keeps mean 0 and deviation 1; so does the deviation of one that hardly varies."""
    seen = panel.where(F.col("date") <= train_end)
    fit = seen.agg(*[f(c).alias(f"_{c}_{k}") for c in columns for k, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_pop))])  # one row
    j = panel.join(F.broadcast(fit), F.lit(True))
    enough = lambda c: F.col(f"_{c}_n") >= least
    z = lambda c: (F.col(c) - F.when(enough(c), F.col(f"_{c}_m")).otherwise(0.0)) / F.when(enough(c) & (F.col(f"_{c}_s") > 1e-9), F.col(f"_{c}_s")).otherwise(1.0)
    known = {f"{c}_known": F.col(c).isNotNull() for c in columns}
    held = {c: F.when(F.col(c).isNull(), 0.0).otherwise(F.greatest(F.lit(-limit), F.least(F.lit(limit), z(c)))) for c in columns}
    return j.withColumns(known | held).select(*panel.columns, *known)


def sample_z(panel: DataFrame, x: str) -> DataFrame:
    """z by sample deviation within a date; 0 where x is missing or does not vary."""
    d = Window.partitionBy("date")
    return panel.withColumn("z", F.coalesce((F.col(x) - F.avg(x).over(d)) / F.nullif(F.stddev_samp(x).over(d), F.lit(0.0)), F.lit(0.0)))


def without_best(daily: DataFrame, x: str, n: int) -> DataFrame:
    """Mean of x over all dates and without its n best ones. daily: one row a session."""
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc(x), "date")
    return daily.where(F.col(x).isNotNull()).withColumn("_i", F.row_number().over(w)).agg(F.avg(x).alias("mean"), F.avg(F.when(F.col("_i") > n, F.col(x))).alias("mean_without"))


def break_even(long: tuple[Column, Column, float], short: tuple[Column, Column, float], year: float = 252.0) -> Column:
    """The cost a trade at which two policies have one Sharpe ratio. A policy is (mean, sample deviation, sessions held) of its returns.

    A policy's ratio at cost c is k * (mean - c) with k the root of its turns a year over its deviation."""
    k = [ratio(F.lit((year / held) ** 0.5), sd) for _, sd, held in (long, short)]
    return F.when(F.abs(k[0] - k[1]) > 1e-12, (k[0] * long[0] - k[1] * short[0]) / (k[0] - k[1]))


def stress(panel: DataFrame, x: str, n: int, least: int = 20) -> DataFrame:
    """date, realized_stress and risk_score, for dates with ``least`` values of x.

    A date's stress is |median| + median deviation from it + 0.02 * |share of negatives - 0.5|. The score is what was known before the date: the mean of
    the n dates before, from five on, and the greatest of the last five."""
    mid = F.percentile(x, 0.5).over(Window.partitionBy("date"))
    some = panel.where(F.col(x).isNotNull()).withColumn("_mid", mid)
    realized = F.abs(F.max("_mid")) + F.percentile(F.abs(F.col(x) - F.col("_mid")), 0.5) + 0.02 * F.abs(F.avg(F.when(F.col(x) < 0, 1.0).otherwise(0.0)) - 0.5)
    daily = some.groupBy("date").agg(F.count("*").alias("_n"), realized.alias("realized_stress")).where(F.col("_n") >= least).drop("_n")
    w = Window.orderBy("date")  # one row a session
    before, five = w.rowsBetween(-n, -1), w.rowsBetween(-5, -1)
    known = lambda f, over: F.when(F.count("realized_stress").over(over) >= 5, f("realized_stress").over(over))
    return daily.withColumn("risk_score", known(F.avg, before) + known(F.max, five))


def sums(panel: DataFrame, x: str, spans: tuple[int, ...]) -> DataFrame:
    """Rolling sums over the rows that are there."""
    return panel.withColumns({f"{x}_{n}": F.sum(x).over(last_rows(n)) for n in spans})


def business_days(a: Column, b: Column) -> Column:
    """Weekdays strictly between two dates."""
    inner = F.sequence(F.date_add(a, 1), F.date_sub(b, 1))
    return F.when(F.datediff(b, a) > 1, F.size(F.filter(inner, lambda d: F.weekday(d) < 5))).otherwise(0)


def next_quarter_end(d: Column) -> Column:
    return F.last_day(F.add_months(d, 3))


def cyclic(x: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a place in a period."""
    return F.sin(x * (2 * math.pi / period)), F.cos(x * (2 * math.pi / period))


def calendar_codes(d: Column) -> dict[str, Column]:
    """year (decades from 2020), and sine and cosine of the month (from 0, of 12) and of the weekday (from 0, of a week of 5)."""
    month, day = cyclic(F.month(d) - 1, 12.0), cyclic(F.weekday(d), 5.0)
    return {"year_code": (F.year(d) - 2020) / 10, "month_sin": month[0], "month_cos": month[1], "week_sin": day[0], "week_cos": day[1]}


def demeaned_skill(panel: DataFrame, pred: str, target: str, least: int = 3) -> DataFrame:
    """Of each date with ``least`` pairs: cells, sums of squares of prediction, target, their product and error, both less their mean of the date, and
    skill, 1 - error over target, null where the target hardly varies."""
    d = Window.partitionBy("date")
    some = panel.where(F.col(pred).isNotNull() & F.col(target).isNotNull())
    c = some.select("date", (F.col(pred) - F.avg(pred).over(d)).alias("_p"), (F.col(target) - F.avg(target).over(d)).alias("_t"))
    p, t = F.col("_p"), F.col("_t")
    g = c.groupBy("date").agg(F.count("*").alias("cells"), F.sum(p * p).alias("prediction_sse"), F.sum(t * t).alias("target_sse"), F.sum(p * t).alias("cross"), F.sum((p - t) ** 2).alias("model_sse")).where(F.col("cells") >= least)
    return g.withColumn("skill", F.when(F.col("target_sse") > 1e-12, 1 - F.col("model_sse") / F.col("target_sse")))


def weighted_correlation(rows: DataFrame, a: str, b: str, group: str) -> DataFrame:
    """Correlation of a and b weighted by the share of b's magnitude; null under two pairs, without magnitude or without variance."""
    r = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(group, F.col(a).alias("_x"), F.col(b).alias("_y"), F.abs(b).alias("_m"))
    w = Window.partitionBy(group)
    r = r.withColumn("_w", ratio(F.col("_m"), F.sum("_m").over(w)))
    c = r.withColumns({"_x": F.col("_x") - F.sum(F.col("_w") * F.col("_x")).over(w), "_y": F.col("_y") - F.sum(F.col("_w") * F.col("_y")).over(w)})
    s = lambda x, y: F.sum(F.col("_w") * F.col(x) * F.col(y))
    return c.groupBy(group).agg(F.when((F.count("*") >= 2) & (s("_x", "_x") > 0) & (s("_y", "_y") > 0), s("_x", "_y") / F.sqrt(s("_x", "_x") * s("_y", "_y"))).alias("correlation"))


def universe_mean(panel: DataFrame, x: str, least: int) -> DataFrame:
    """Mean change of x against the entity's row before, on dates with ``least`` entities."""
    c = panel.where(F.col(x).isNotNull()).withColumn("_c", ratio(F.col(x), F.lag(x).over(by())) - 1)
    return c.groupBy("date").agg(F.count("_c").alias("n"), F.avg("_c").alias("mean")).where(F.col("n") >= least)

