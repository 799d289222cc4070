"""Paths after a shock or over horizons: open-shock trajectories, peaks, and weights of signals by what they have earned."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import pearson, ratio


def open_shock(gaps: DataFrame, closes: DataFrame, horizons: list[int], least: int = 20) -> DataFrame:
    """One row a date and horizon with ``least`` entities: how the market went on after its opening gap.

    gaps: (date, ticker, gap); closes: (date, ticker, horizon, from_open), the return from the open to the horizon's close; nulls are not valid. A date
    needs ``least`` gaps and a direction: the sign of the median gap, of the mean where that is nil. Columns: direction, open_energy (root of the squared median
    gap and the squared median size times the directional breadth), open_median, open_breadth; remaining, aligned_remaining and aligned_total (median return from the open, along the
    direction, and with the gap), extension beyond the median gap, aligned_breadth, continuation (share of entities that go on), and up to the horizon: the market's best and
    worst aligned return, the horizon of the first best, and the median over entities of their own best and worst."""
    g = gaps.where("gap is not null").select("date", "ticker", "gap")
    mid = lambda x: F.percentile(x, 0.5)
    d = g.groupBy("date").agg(F.count("*").alias("_n"), mid("gap").alias("open_median"), F.avg("gap").alias("_mean"), F.avg(F.signum("gap")).alias("_sign"), mid(F.abs("gap")).alias("_abs")).where(F.col("_n") >= least)
    d = d.withColumn("direction", F.signum(F.when(F.abs("open_median") > 1e-12, F.col("open_median")).otherwise(F.col("_mean")))).where("direction != 0")
    d = d.withColumn("open_breadth", F.col("direction") * F.col("_sign"))
    d = d.withColumn("open_energy", F.sqrt(F.col("open_median") ** 2 + (F.col("_abs") * F.greatest("open_breadth", F.lit(0.0))) ** 2)).drop("_n", "_mean", "_sign", "_abs")
    j = closes.where(F.col("from_open").isNotNull() & F.col("horizon").isin(horizons)).join(g, ["date", "ticker"]).join(d.select("date", "direction"), "date")
    j = j.withColumns({"_total": (1 + F.col("gap")) * (1 + F.col("from_open")) - 1, "_along": F.col("direction") * F.col("from_open"), "_n": F.count("*").over(Window.partitionBy("date", "horizon"))}).where(F.col("_n") >= least)
    m = j.groupBy("date", "horizon").agg(
        mid("from_open").alias("remaining"), mid("_total").alias("_market"), F.avg(F.col("direction") * F.signum("_total")).alias("aligned_breadth"), F.avg(F.when(F.col("_along") > 0, 1.0).otherwise(0.0)).alias("continuation")
    )
    m = m.join(d, "date").withColumns({"aligned_remaining": F.col("direction") * F.col("remaining"), "aligned_total": F.col("direction") * F.col("_market")})
    upto = Window.partitionBy("date").orderBy("horizon").rowsBetween(Window.unboundedPreceding, 0)
    best = F.max(F.struct(F.col("aligned_remaining").alias("v"), (-F.col("horizon")).alias("h"))).over(upto)  # the first horizon of equals
    m = m.withColumns({"extension": F.col("aligned_total") - F.abs("open_median"), "_best": best, "market_mae": F.min("aligned_remaining").over(upto)})
    # each entity on all horizons, so that a best value stays with it where it has no close
    own = j.groupBy("date", "ticker").agg(F.map_from_entries(F.collect_list(F.struct("horizon", "_along"))).alias("_path"))
    kind = closes.schema["horizon"].dataType
    grid = own.select("date", "ticker", "_path", F.explode(F.array(*[F.lit(h).cast(kind) for h in sorted(horizons)])).alias("horizon")).withColumn("_v", F.col("_path")[F.col("horizon")])
    w = Window.partitionBy("date", "ticker").orderBy("horizon").rowsBetween(Window.unboundedPreceding, 0)
    n = grid.withColumns({"_up": F.max("_v").over(w), "_down": F.min("_v").over(w)}).groupBy("date", "horizon").agg(F.when(F.count("_up") >= least, mid("_up")).alias("node_mfe"), F.when(F.count("_down") >= least, mid("_down")).alias("node_mae"))
    out = m.join(n, ["date", "horizon"]).withColumns({"market_mfe": F.col("_best.v"), "time_to_peak": -F.col("_best.h")})
    names = "direction open_energy open_median open_breadth remaining aligned_remaining aligned_total extension aligned_breadth continuation market_mfe market_mae node_mfe node_mae time_to_peak"
    return out.select("date", "horizon", *names.split())


def path_peaks(rows: DataFrame, split: str, date: str, horizon: str, salience: str, fit: str, quantile: float = 0.9) -> DataFrame:
    """One row a (split, date): the horizon of greatest salience (the later of equals), its salience, the second horizon (-1: none), the relative margin, and
    major_event, whether the salience reaches the fit split's quantile. Fewer than twenty fit dates are an error."""
    w = Window.partitionBy(split, date).orderBy(F.desc(salience), F.desc(horizon))
    r = rows.where(F.col(salience).isNotNull()).withColumns({"_i": F.row_number().over(w), "_second": F.lead(horizon).over(w), "_next": F.lead(salience).over(w)}).where("_i = 1")
    top = F.col(salience)
    p = r.select(split, date, top.alias("path_salience"), F.col(horizon).alias("peak_horizon"), F.coalesce("_second", F.lit(-1)).alias("second_horizon"), F.when(top > 1e-12, (top - F.col("_next")) / top).otherwise(0.0).alias("relative_margin"))
    known = p.where(F.col(split) == fit).agg(F.when(F.count("*") >= 20, F.percentile("path_salience", quantile)).otherwise(F.raise_error(F.lit("at least twenty fit paths are required")).cast("double")).alias("_t"))  # one row
    return p.join(F.broadcast(known), F.lit(True)).withColumn("major_event", F.col("path_salience") >= F.col("_t")).drop("_t")


def selected_peaks(rows: DataFrame, date: str, score: str, tie: str, rate: float | None = None, threshold: float | None = None) -> DataFrame:
    """The best row of each date (ties: the least ``tie``), of these the share ``rate`` of best scores, rounded up, 1 at least, and those of ``threshold`` at least."""
    w = Window.partitionBy(date).orderBy(F.desc(score), tie)
    peaks = rows.where(F.col(score).isNotNull()).withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")  # one row a date from here on
    if rate is not None:
        n = F.count("*").over(Window.partitionBy(F.lit(1)))
        peaks = peaks.withColumns({"_n": n, "_k": F.row_number().over(Window.orderBy(F.desc(score), date))}).where(F.col("_k") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * rate))).drop("_n", "_k")
    return peaks if threshold is None else peaks.where(F.col(score) >= threshold)


def classification(rows: DataFrame, group: str, probability: str, label: str, prior: Column) -> DataFrame:
    """rows, positive_fraction, brier, brier_skill (against a constant prior), accuracy and balanced_accuracy of each group; probabilities are kept within 1e-6 of 0 and 1.

    balanced_accuracy is the mean hit rate of the labels that occur."""
    r = rows.where(F.col(probability).isNotNull() & F.col(label).isNotNull()).select(group, F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(probability))).alias("_p"), F.col(label).cast("int").alias("_y"), prior.alias("_q"))
    hit = (F.col("_p") >= 0.5).cast("int") == F.col("_y")
    rate = lambda y: F.avg(F.when(F.col("_y") == y, hit.cast("double")))
    brier, base = F.avg((F.col("_y") - F.col("_p")) ** 2), F.avg((F.col("_y") - F.col("_q")) ** 2)
    return r.groupBy(group).agg(F.count("*").alias("rows"), F.avg("_y").alias("positive_fraction"), brier.alias("brier"), F.when(base > 1e-12, 1 - brier / base).alias("brier_skill"), F.avg(hit.cast("double")).alias("accuracy"), ((F.coalesce(rate(0), rate(1)) + F.coalesce(rate(1), rate(0))) / 2).alias("balanced_accuracy"))


def positive_ic_weights(daily: DataFrame, signal: str, ic: str) -> DataFrame:
    """(signal, mean_ic, weight): each signal's mean daily correlation, and its share of the positive ones; equal shares if none is positive. Signals without any have no correlation."""
    m = daily.groupBy(signal).agg(F.avg(ic).alias("mean_ic"))  # one row a signal from here on
    all_ = Window.partitionBy(F.lit(1))
    up = F.greatest(F.coalesce("mean_ic", F.lit(0.0)), F.lit(0.0))
    total, n, whole = F.sum(up).over(all_), F.count("*").over(all_), F.min(F.col("mean_ic").isNotNull()).over(all_)
    return m.withColumn("weight", F.when((total > 1e-12) & whole, ratio(up, total)).otherwise(1.0 / n))


def signal_correlations(panel: DataFrame, signals: list[str], least: int = 11) -> DataFrame:
    """(a, b, dates, correlation): of every two signals the mean over dates of their correlation, dates with ``least`` pairs; one pass over the panel."""
    both = lambda x, y, v: F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), v)
    pairs = list(combinations(signals, 2))
    g = panel.groupBy("date").agg(*[F.when((F.count(both(x, y, F.lit(1))) >= least) & (F.stddev_pop(both(x, y, F.col(x))) > 1e-12) & (F.stddev_pop(both(x, y, F.col(y))) > 1e-12), pearson(both(x, y, F.col(x)), both(x, y, F.col(y)))).alias(f"_{i}") for i, (x, y) in enumerate(pairs)])
    one = g.agg(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.count(f"_{i}").alias("dates"), F.avg(f"_{i}").alias("correlation")).alias(f"_{i}") for i, (x, y) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[f"_{i}" for i in range(len(pairs))])).alias("x")).select("x.*").where("dates > 0")
