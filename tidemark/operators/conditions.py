"""Market conditions: outside factors, flows against turnover, turnover summaries, robust scales, transition labels, reactions, budgets.

Frames keyed by entity partition by it; those of one factor or one market hold one row a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .frames import by, full, last_rows, prior_rows
from .panel import ratio

RETURN_SPANS = (1, 5, 20)
LEVEL_SPANS = (1, 20, 252)


def align(panel_dates: DataFrame, factor: DataFrame, x: str, lag: int, key: str = "factor") -> DataFrame:
    """Each factor on every session of ``panel_dates`` (key, date): the last known value, ``lag`` sessions late."""
    joined = panel_dates.join(factor.where(F.col(x).isNotNull()), [key, "date"], "left")
    filled = joined.withColumn(x, F.last(x, ignorenulls=True).over(by(key).rowsBetween(Window.unboundedPreceding, 0)))
    return filled.withColumn(x, F.lag(x, lag).over(by(key))) if lag else filled


def _moments(x: Column, w: WindowSpec, n: int) -> tuple[Column, Column]:
    return full(F.avg(x), x, w, n), full(F.stddev_samp(x), x, w, n)


def market_factor(rows: DataFrame, x: str, key: str = "factor") -> DataFrame:
    """Returns, volatility, z of the log level and the gap to the mean of 20 sessions."""
    w20, w60, c = last_rows(20, key), last_rows(60, key), F.col(x)
    log = F.when(c > 0, F.log(c))
    back = {f"ret{k}": ratio(c, F.lag(x, k).over(by(key))) - 1 for k in RETURN_SPANS}
    mean, sd = _moments(log, w60, 60)
    got = rows.withColumns(back)
    return got.withColumns({
        "vol20": full(F.stddev_samp("ret1"), F.col("ret1"), w20, 20),
        "level_z60": ratio(log - mean, sd),
        "ma20_gap": ratio(c, full(F.avg(x), c, w20, 20)) - 1,
    })


def policy_factor(rows: DataFrame, x: str, span: int = 252, key: str = "factor") -> DataFrame:
    """Level, changes, log of sessions since the last change, z of the level; sessions count from the first where none changed yet."""
    c, o = F.col(x), by(key)
    mean, sd = _moments(c, last_rows(span, key), span)
    got = rows.withColumns({f"change_{k}d": c - F.lag(x, k).over(o) for k in LEVEL_SPANS} | {f"level_z{span}": ratio(c - mean, sd), "_i": F.row_number().over(o)})
    at = F.last(F.when(F.coalesce(F.col("change_1d"), F.lit(0.0)) != 0, F.col("_i")), ignorenulls=True).over(o.rowsBetween(Window.unboundedPreceding, 0))
    return got.withColumn("days_since_change", F.log1p((F.col("_i") - F.coalesce(at, F.lit(1))).cast("double"))).drop("_i")


def flow_ratios(rows: DataFrame, flow: str, value: str, spans: tuple[int, ...] = (1, 5, 20), lag: int = 1, bound: float = 5.0) -> DataFrame:
    """Net flow over turnover, both ``lag`` sessions late, summed over full spans and kept within the bound."""
    late = rows.withColumns({"_flow": F.lag(flow, lag).over(by()), "_value": F.lag(F.nullif(F.col(value), F.lit(0.0)), lag).over(by())})

    def one(n: int) -> Column:
        f, v, w = F.col("_flow"), F.col("_value"), last_rows(n)
        q = ratio(full(F.sum(f), f, w, n), full(F.sum(v), v, w, n))
        return F.greatest(F.least(q, F.lit(bound)), F.lit(-bound))

    return late.withColumns({f"{flow}_ratio_{n}d": one(n) for n in spans}).drop("_flow", "_value")


def trailing_turnover(rows: DataFrame, start, end) -> DataFrame:
    """Observations, mean and median of close times volume within start..end; both must be positive. Entities without any stay, with nulls."""
    good = F.col("date").between(F.lit(start), F.lit(end)) & (F.col("close") > 0) & (F.col("volume") > 0)
    t = F.when(good, F.col("close") * F.col("volume"))
    return rows.groupBy("ticker").agg(F.count(t).alias("observations"), F.avg(t).alias("mean_turnover"), F.median(t).alias("median_turnover"))


def robust_scale(long: DataFrame, feature: str, x: str, least: int = 3, floor: float = 1e-6) -> DataFrame:
    """center and scale of each feature: median and 1.4826 times the median distance from it, else the root mean square
    distance, else 1; features with fewer than ``least`` values get 0 and 1."""
    center = long.groupBy(feature).agg(F.median(x).alias("_m"))  # one row a feature
    d = long.join(center, feature).withColumn("_d", F.abs(F.col(x) - F.col("_m")))
    s = d.groupBy(feature).agg(F.count(x).alias("n"), F.first("_m").alias("_m"), (F.median("_d") * 1.4826).alias("_mad"), F.sqrt(F.avg(F.col("_d") ** 2)).alias("_rms"))
    scale = F.when(F.col("_mad") >= floor, F.col("_mad")).when(F.col("_rms") >= floor, F.col("_rms")).otherwise(1.0)
    enough = F.col("n") >= least
    return s.select(feature, "n", F.when(enough, F.col("_m")).otherwise(0.0).alias("center"), F.when(enough, scale).otherwise(1.0).alias("scale"))


def transition_labels(scores: DataFrame, thresholds: dict[str, Column], selloff: Column) -> DataFrame:
    """event_<family>, broad_selloff, systemic_event, and systemic_impact: the greatest family over its threshold, 1 at
    least in a selloff, null unless all families are there."""
    sell = F.coalesce(selloff, F.lit(False))
    over = {f: F.col(f) / F.greatest(t, F.lit(1e-12)) for f, t in thresholds.items()}
    events = {f"event_{f}": F.coalesce(F.col(f) >= t, F.lit(False)) for f, t in thresholds.items()}
    whole = F.lit(True)
    for f in thresholds:
        whole = whole & F.col(f).isNotNull()
    some = sell
    for e in events.values():
        some = some | e
    top = F.greatest(*over.values(), sell.cast("double"))
    return scores.withColumns(events | {"broad_selloff": sell, "systemic_event": some, "systemic_impact": F.when(whole, top)})


def reactions(panel: DataFrame, at: Column, drift: int) -> DataFrame:
    """Rows where ``at`` holds, with the next session's return, the drift of ``drift`` sessions after it and the size of
    its opening gap; rows without so many sessions to come or without both closes go."""
    ahead = {"_c1": F.lead("close", 1), "_o1": F.lead("open", 1), "_cd": F.lead("close", 1 + drift), "_has": F.lead("date", 1 + drift)}
    p = panel.withColumns({k: v.over(by()) for k, v in ahead.items()} | {"_at": at})
    p = p.where(F.col("_at") & F.col("_has").isNotNull() & (F.col("close") > 0) & F.col("_c1").isNotNull())
    return p.withColumns({
        "reaction": F.col("_c1") / F.col("close") - 1,
        "drift": F.when(F.col("_c1") > 0, F.col("_cd") / F.col("_c1") - 1),
        "gap": F.abs(F.col("_o1") / F.col("close") - 1),
    }).drop("_at", "_has", "_c1", "_o1", "_cd")


def budget(panel: DataFrame, score: str, top: int, least: int, span: int, strength: float, low: float, high: float) -> DataFrame:
    """date and multiplier: 1 + strength * z of the mean of the best ``top`` scores against the ``span`` sessions before,
    within low..high; 1 for the first ``span`` sessions. Sessions with fewer than ``least`` scores go."""
    w = Window.partitionBy("date")
    some = panel.where(F.col(score).isNotNull()).withColumns({"_n": F.count("*").over(w), "_i": F.row_number().over(w.orderBy(F.desc(score), "ticker"))})
    raw = some.where((F.col("_n") >= least) & (F.col("_i") <= top)).groupBy("date").agg(F.avg(score).alias("_raw"))  # one row a session
    one = raw.withColumns({"_one": F.lit(1)})
    before, i = prior_rows(span, "_one"), F.row_number().over(by("_one"))
    z = (F.col("_raw") - F.avg("_raw").over(before)) / (F.stddev_pop("_raw").over(before) + 1e-12)
    return one.select("date", F.when(i <= span, 1.0).otherwise(F.least(F.lit(high), F.greatest(F.lit(low), 1 + strength * z))).alias("multiplier"))


def last_values(rows: DataFrame, group: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The last value of each column in a group that is not null, each column on its own."""
    place = F.struct(*order)
    return rows.groupBy(*group).agg(*[F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), place)).alias(c) for c in columns])


def usable_sessions(panel: DataFrame, targets: list[str], warmup: int, least: int) -> DataFrame:
    """date and usable: past ``warmup`` sessions, with ``least`` values of every target."""
    per = panel.groupBy("date").agg(*[F.count(t).alias(f"_{t}") for t in targets])  # one row a session
    ok = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("date")) > warmup
    for t in targets:
        ok = ok & (F.col(f"_{t}") >= least)
    return per.select("date", ok.alias("usable"))
