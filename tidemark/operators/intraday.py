"""Paths within a session: bars on a grid of minutes, what was known at each decision, what came after, and the market's summary of it.

Bars are rows (ticker, session, minute, open, high, low, close, volume); minute is the label counted from midnight, at the bar's start or end
(``at_end``). A bar with a null, a price that is not positive or a negative volume counts as missing; nothing is filled forward. A label outside the
grid takes no part, but for the closing auction. A ticker's session is one bounded group: its bars are joined into one map, so that grid, running
values and paths share one shuffle; values by the clock of earlier sessions are a second one. An empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import ratio

_PRICES = ("open", "high", "low", "close")
_KEYS = ["ticker", "session"]


@dataclass(frozen=True)
class Hours:
    """A session's clock in minutes from midnight. Bars of ``interval`` minutes go from ``first`` to ``close``; the auction's bar has a label of its own, ``auction``."""

    interval: int
    first: int
    close: int
    auction: int
    at_end: bool = False

    def __post_init__(self) -> None:
        if self.interval <= 0 or self.close <= self.first or (self.close - self.first) % self.interval:
            raise ValueError("a session must be whole intervals")
        if self.auction < self.close + self.at_end:
            raise ValueError("the auction's label must lie behind the grid")

    @property
    def bars(self) -> int:
        return (self.close - self.first) // self.interval

    @property
    def label(self) -> int:
        """The label of the grid's first bar."""
        return self.first + (self.interval if self.at_end else 0)

    def slot(self, minute: Column) -> Column:
        """A label's place on the grid, null beside it."""
        from_first = minute - self.label
        on = (from_first >= 0) & (from_first % self.interval == 0) & (from_first < self.bars * self.interval)
        return F.when(on, (from_first / self.interval).cast("int"))


def valid_bars(bars: DataFrame) -> DataFrame:
    ok = F.least(*_PRICES) > 0
    for c in _PRICES:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    ok = ok & (F.col("volume") >= 0) & (F.col("volume") < float("inf"))
    return bars.select(*_KEYS, "minute", *_PRICES, F.col("volume").cast("double").alias("volume")).where("ticker is not null and session is not null and minute is not null").where(ok)


def grid(bars: DataFrame, hours: Hours) -> DataFrame:
    """One row a ticker, session and slot with bar (null where missing), auction (the closing bar or null) and session_open, the first slot's open.

    Two bars of one label are an error, as they leave open which is meant."""
    bar = F.struct(*_PRICES, "volume")
    slot = F.when(F.col("minute") == hours.auction, F.lit(-1)).otherwise(hours.slot(F.col("minute")))
    rows = valid_bars(bars).withColumn("slot", slot).where("slot is not null")
    whole = rows.groupBy(*_KEYS).agg(F.map_from_entries(F.collect_list(F.struct("slot", bar.alias("bar")))).alias("_bars"))
    at = lambda s: F.try_element_at("_bars", s)
    slots = F.explode(F.sequence(F.lit(0), F.lit(hours.bars - 1))).alias("slot")
    every = whole.select(*_KEYS, "_bars", at(F.lit(-1)).alias("auction"), at(F.lit(0))["open"].alias("session_open"), slots)
    return every.select(*_KEYS, "slot", at(F.col("slot")).alias("bar"), "auction", "session_open")


def _by(lo: int | None, hi: int | None):
    w = Window.partitionBy(*_KEYS).orderBy("slot")
    return w.rowsBetween(Window.unboundedPreceding if lo is None else lo, Window.unboundedFollowing if hi is None else hi)


def _steps(g: DataFrame) -> DataFrame:
    """The grid with its bar's columns and step, the return from the bar before; the first bar's is from the session's open."""
    w = Window.partitionBy(*_KEYS).orderBy("slot")
    flat = g.select(*_KEYS, "slot", "auction", "session_open", *[F.col(f"bar.{c}").alias(c) for c in (*_PRICES, "volume")])
    before = F.when(F.col("slot") == 0, F.col("session_open")).otherwise(F.lag("close").over(w))
    return flat.withColumn("step", F.col("close") / before - 1)


def _decides(hours: Hours, start: int, end: int) -> tuple[Column, Column]:
    """A row's decision minute (when its bar is complete), and whether a decision is due and possible there."""
    if start < hours.first + hours.interval or end > hours.close - hours.interval or start > end or (start - hours.first) % hours.interval or (end - hours.first) % hours.interval:
        raise ValueError("decisions must fall on the grid and leave a bar on both sides")
    minute = (hours.first + (F.col("slot") + 1) * hours.interval).cast("int")
    return minute, minute.between(start, end) & F.col("session_open").isNotNull() & F.col("close").isNotNull()


def clock_shock(df: DataFrame, keys: list[str], x: str | Column, window: int = 20, least: int = 10) -> Column:
    """x less the median of its last ``window`` rows of the same keys, in order of sessions; null under ``least`` values among them."""
    if not 1 <= least <= window:
        raise ValueError("a baseline needs 1 <= least <= window")
    x = F.col(x) if isinstance(x, str) else x
    w = Window.partitionBy(*keys).orderBy("session").rowsBetween(-window, -1)
    return F.when(F.count(x).over(w) >= least, x - F.percentile(x, F.lit(0.5)).over(w))


SHOCKS = {
    "cumulative_volume_shock": "log_cumulative_volume",
    "cumulative_value_shock": "log_cumulative_value",
    "recent_volume_1_shock": "log_recent_volume_1",
    "recent_volume_3_shock": "log_recent_volume_3",
    "absolute_return_3_shock": "_scaled_absolute_return_3",
}


def decisions(bars: DataFrame, hours: Hours, start: int, end: int, short: int = 3, long: int = 6, window: int = 20, least: int = 10) -> DataFrame:
    """One row a ticker, session and decision minute with what was known then; ``short`` and ``long`` count bars (columns end in 3 and 6 whatever they are).

    A decision needs the first bar and the one just completed. Trailing values need all their bars and the one before them (the session's open
    at the first), cumulative ones an unbroken run of bars. previous_close is the last auction close of an earlier session. The shocks are against earlier sessions' same clock."""
    s = _steps(grid(bars, hours))
    closes = s.where("slot = 0").select(*_KEYS, F.col("auction.close").alias("_c"))
    earlier = Window.partitionBy("ticker").orderBy("session").rowsBetween(Window.unboundedPreceding, -1)
    closes = closes.select(*_KEYS, F.last("_c", ignorenulls=True).over(earlier).alias("previous_close"))
    known, all_known = F.count("close").over(_by(None, 0)), F.col("_known") == F.col("slot") + 1
    w = Window.partitionBy(*_KEYS).orderBy("slot")

    def back(n: int) -> Column:
        edge = F.when(F.col("slot") + 1 == n, F.col("session_open")).otherwise(F.lag("close", n).over(w))
        return F.when(F.count("close").over(_by(1 - n, 0)) == n, F.col("close") / edge - 1)

    def absolute(n: int) -> Column:
        return F.when(F.count("step").over(_by(1 - n, 0)) == n, F.sum(F.abs("step")).over(_by(1 - n, 0)))

    typical = (F.col("open") + F.col("high") + F.col("low") + F.col("close")) * 0.25
    volume, value = F.sum("volume").over(_by(None, 0)), F.sum(typical * F.col("volume")).over(_by(None, 0))
    seen = F.max(F.when(F.col("close").isNotNull(), F.col("slot"))).over(_by(None, -1))
    s = s.withColumns(
        {
            "_known": known, "_volume": volume, "_value": value, "_high": F.max("high").over(_by(None, 0)), "_low": F.min("low").over(_by(None, 0)),
            "return_1": back(1), "return_3": back(short), "return_6": back(long), "absolute_return_3": absolute(short), "absolute_return_6": absolute(long),
            "log_recent_volume_3": F.when(F.count("volume").over(_by(1 - short, 0)) == short, F.log1p(F.sum("volume").over(_by(1 - short, 0)))),
            "missing_since_previous": F.coalesce(F.col("slot") - seen - 1, F.col("slot")),
        }
    )
    minute, due = _decides(hours, start, end)
    d = s.where(due).join(closes, _KEYS)
    d = d.select(
        *_KEYS, minute.alias("minute"), F.col("close").alias("decision_price"),
        ((minute - hours.first) / float(hours.close - hours.first)).alias("clock_fraction"),
        (F.col("session_open") / F.col("previous_close") - 1).alias("gap_open"), (F.col("close") / F.col("previous_close") - 1).alias("return_from_previous_close"),
        (F.col("close") / F.col("session_open") - 1).alias("return_from_open"), "return_1", "return_3", "return_6",
        F.when(all_known, F.col("_high") / F.col("_low") - 1).alias("cumulative_range"), "absolute_return_3", "absolute_return_6",
        F.when(all_known, F.log1p("_volume")).alias("log_cumulative_volume"), F.when(all_known, F.log1p("_value")).alias("log_cumulative_value"),
        F.log1p("volume").alias("log_recent_volume_1"), "log_recent_volume_3",
        F.when(all_known & (F.col("_value") > 0), F.col("close") / ratio(F.col("_value"), F.col("_volume")) - 1).alias("price_to_vwap"),
        "missing_since_previous", (1 - F.col("_known") / (F.col("slot") + 1)).alias("missing_fraction"),
    )
    d = d.withColumn("_scaled_absolute_return_3", F.log1p(F.col("absolute_return_3") * 10_000))
    return d.withColumns({name: clock_shock(d, ["ticker", "minute"], x, window, least) for name, x in SHOCKS.items()}).drop("_scaled_absolute_return_3")


TARGETS = ("endpoint_return", "mfe", "mae", "absolute_return", "future_range", "time_to_peak", "time_to_trough", "future_volume_shock")


def path_targets(bars: DataFrame, hours: Hours, start: int, end: int, horizons: list[int], window: int = 20, least: int = 10) -> DataFrame:
    """One row a decision and horizon (minutes; 0 is the closing auction) with the path after it, never the bar before.

    The endpoint's return needs the endpoint's bar only; all else every bar of the horizon, and the auction's for the close. Times to peak and trough are shares
    of the horizon up to the first greatest high and least low. future_volume_shock is the logarithm of the path's volume against earlier sessions' same clock and horizon."""
    if not horizons or sorted(set(horizons)) != list(horizons) or any(h <= 0 or h % hours.interval for h in horizons):
        raise ValueError("horizons must ascend and be whole intervals")
    s = _steps(grid(bars, hours))
    price, slot = F.col("close"), F.col("slot")
    w = Window.partitionBy(*_KEYS).orderBy("slot")
    paths = {}
    for h in [*horizons, 0]:
        k = h // hours.interval
        f = _by(1, k or None)
        need = F.lit(k) if h else F.lit(hours.bars - 1) - slot
        paths[h] = F.struct(
            (F.lead("close", k).over(w) if h else F.col("auction.close")).alias("end"),
            (F.count("close").over(f) == need).alias("whole"), F.sum(F.abs("step")).over(f).alias("moved"), F.sum("volume").over(f).alias("volume"),
            F.max(F.struct("high", (-slot).alias("at"))).over(f).alias("top"), F.min(F.struct("low", slot.alias("at"))).over(f).alias("bottom"),
            F.last("close", ignorenulls=True).over(_by(0, k or None)).alias("last"),
        )
    s = s.withColumns({f"_{h}": x for h, x in paths.items()})
    minute, due = _decides(hours, start, end)
    long = s.where(due).select(*_KEYS, "slot", minute.alias("minute"), price.alias("price"), "auction", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_{h}").alias("p")) for h in paths])).alias("x"))
    long = long.select(*_KEYS, "slot", "minute", "price", "auction", "x.horizon", "x.p.*")
    close = F.col("horizon") == 0
    whole = F.col("whole") & F.col("end").isNotNull()
    span = F.when(close, hours.auction - F.col("minute")).otherwise(F.col("horizon")).cast("double")
    late = lambda better: close & F.coalesce(better, F.lit(True))  # noqa: E731  the auction's bar is the last of the path
    peak_late, trough_late = late(F.col("auction.high") > F.col("top.high")), late(F.col("auction.low") < F.col("bottom.low"))
    high = F.when(peak_late, F.col("auction.high")).otherwise(F.col("top.high"))
    low = F.when(trough_late, F.col("auction.low")).otherwise(F.col("bottom.low"))
    share = lambda is_late, at: F.when(is_late, 1.0).otherwise((at - slot) * hours.interval / span)
    moved = F.coalesce("moved", F.lit(0.0)) + F.when(close, F.abs(F.col("end") / F.col("last") - 1)).otherwise(0.0)
    volume = F.coalesce("volume", F.lit(0.0)) + F.when(close, F.col("auction.volume")).otherwise(0.0)
    t = long.select(
        *_KEYS, "minute", "horizon", (F.col("end") / F.col("price") - 1).alias("endpoint_return"),
        *[F.when(whole, x).alias(n) for n, x in (("mfe", high / F.col("price") - 1), ("mae", low / F.col("price") - 1), ("absolute_return", moved), ("future_range", F.greatest(high, "price") / F.least(low, "price") - 1), ("time_to_peak", share(peak_late, -F.col("top.at"))), ("time_to_trough", share(trough_late, F.col("bottom.at"))), ("_volume", F.log1p(volume)))],
    )
    return t.withColumn("future_volume_shock", clock_shock(t, ["ticker", "minute", "horizon"], "_volume", window, least)).drop("_volume")


SYSTEMIC = (
    "median_return", "mean_return", "return_energy", "mean_absolute_return", "return_dispersion", "positive_breadth", "negative_breadth", "move_breadth", "direction_coherence",
    "median_mfe", "median_mae", "median_future_range", "state_change_energy", "median_volume_shock", "volume_expansion_breadth",
)


def systemic_summary(targets: DataFrame, least: int = 20, move: float = 0.005, expansion: float = 1.5) -> DataFrame:
    """Fifteen values of all tickers a (session, minute, horizon): nine of endpoint returns, four of whole paths, two of volume shocks; each set is null under ``least`` tickers of its own."""
    r, v = F.col("endpoint_return"), F.col("future_volume_shock")
    path = r.isNotNull() & F.col("mfe").isNotNull() & F.col("mae").isNotNull() & F.col("future_range").isNotNull()
    mid = lambda x: F.percentile(x, F.lit(0.5))
    held = lambda x: F.avg(x.cast("int"))
    on = lambda c: F.when(path, F.col(c))
    sets = [
        (F.count(r), [mid(r), F.avg(r), F.sqrt(F.avg(r * r)), F.avg(F.abs(r)), F.stddev_pop(r), held(r > 0), held(r < 0), held(F.abs(r) >= move), F.when(F.avg(F.abs(r)) > 1e-12, F.abs(F.avg(r)) / F.avg(F.abs(r))).otherwise(0.0)]),
        (F.count(F.when(path, 1)), [mid(on("mfe")), mid(on("mae")), mid(on("future_range")), F.sqrt(F.avg(F.when(path, r * r + F.col("future_range") * F.col("future_range") * 0.25)))]),
        (F.count(v), [mid(v), held(v >= F.log(F.lit(expansion)))]),
    ]
    values = [F.when(n >= least, x) for n, xs in sets for x in xs]
    return targets.groupBy("session", "minute", "horizon").agg(*[x.alias(name) for name, x in zip(SYSTEMIC, values)])


def early_window(bars: DataFrame, hours: Hours, decision: int) -> DataFrame:
    """One row a ticker and session with bars that are complete at the minute ``decision``: open, price, return, range, sum of absolute steps between the bars there are, volume,
    traded value, bars there and expected, the share of expected labels there, and whether the bars are exactly the expected ones."""
    expected = (decision - hours.first) // hours.interval
    if (decision - hours.first) % hours.interval or not 1 <= expected <= hours.bars:
        raise ValueError("the window must be whole intervals within the session")
    m = F.col("minute")
    inside = ((m > hours.first) & (m <= decision)) if hours.at_end else ((m >= hours.first) & (m + hours.interval <= decision))
    w = Window.partitionBy(*_KEYS).orderBy("minute")
    b = valid_bars(bars).where(inside).withColumn("_step", F.col("close") / F.coalesce(F.lag("close").over(w), F.col("open")) - 1)
    typical = (F.col("open") + F.col("high") + F.col("low") + F.col("close")) * 0.25
    matched = F.count(hours.slot(m))
    g = b.groupBy(*_KEYS).agg(
        F.min_by("open", "minute").alias("session_open"), F.max_by("close", "minute").alias("decision_price"), (F.max("high") / F.min("low") - 1).alias("early_range"),
        F.sum(F.abs("_step")).alias("absolute_return"), F.sum("volume").alias("early_volume"), F.sum(typical * F.col("volume")).alias("early_value"),
        F.count("*").alias("bars"), F.lit(expected).cast("long").alias("expected_bars"), (matched / F.lit(expected)).alias("coverage"),
        ((F.count("*") == expected) & (matched == expected)).alias("complete"),
    )
    return g.withColumn("early_return", F.col("decision_price") / F.col("session_open") - 1)


def session_labels(bars: DataFrame, hours: Hours) -> DataFrame:
    """One row a ticker and session: close, high, low, volume, bars and last label of all its bars, and whether the grid and the auction are whole and the auction is last."""
    b = valid_bars(bars)
    matched = F.count(F.coalesce(hours.slot(F.col("minute")), F.when(F.col("minute") == hours.auction, F.lit(-1))))
    return b.groupBy(*_KEYS).agg(
        F.max_by("close", "minute").alias("session_close"), F.max("high").alias("session_high"), F.min("low").alias("session_low"), F.sum("volume").alias("session_volume"),
        F.count("*").alias("bars"), F.max("minute").alias("last_minute"), ((F.max("minute") == hours.auction) & (matched == hours.bars + 1)).alias("complete"),
    )
