"""Queries of paths within sessions, over bars of two hours of the event stream, and of residual surprise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import register
from ..operators import conditions, intraday, surprise
from ..sources.readers import parquet_table as table
from ..sources.shared import written
from .panel_queries import DENSE, r6, s6, with_returns

HOURS = intraday.Hours(120, 0, 1320, 1330)
_START, _END, _HORIZONS = 240, 1200, [120, 240, 480]


def session_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of eight groups of users as bars; the last two hours stand for the closing auction. Order within a bar is by a key of 64 bits."""
    e = table(spark, sf_dir, "events").where("value > 0")
    micros = (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.expr("extract(SECOND FROM ts)")) * 1_000_000
    e = e.select((F.col("user_id") % 8).alias("ticker"), F.col("ts").cast("date").alias("session"), (micros.cast("long") * (1 << 26) + F.pmod("event_id", F.lit(1 << 26))).alias("_key"), (F.floor(F.hour("ts") / 2) * 120).cast("int").alias("_m"), "value")
    e = e.withColumn("minute", F.when(F.col("_m") == 1320, 1330).otherwise(F.col("_m")))
    return e.groupBy("ticker", "session", "minute").agg(F.min_by("value", "_key").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "_key").alias("close"), F.sum("value").alias("volume"))


_BARS = """b AS (SELECT user_id % 8 AS ticker, CAST(ts AS DATE) AS session, CASE WHEN hour(ts) >= 22 THEN 1330 ELSE hour(ts) // 2 * 120 END AS minute,
 first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, sum(value) AS volume FROM events WHERE value > 0 GROUP BY ALL)"""
_PART = "PARTITION BY ticker, session ORDER BY slot"
_GRID = f"""{_BARS}, g AS (SELECT t.ticker, t.session, s.slot, b.open, b.high, b.low, b.close, b.volume, a.close AS a_close, a.high AS a_high, a.low AS a_low, a.volume AS a_volume, o.open AS session_open
 FROM (SELECT DISTINCT ticker, session FROM b) t CROSS JOIN (SELECT unnest(range(11)) AS slot) s LEFT JOIN b ON b.ticker = t.ticker AND b.session = t.session AND b.minute = slot * 120
 LEFT JOIN b a ON a.ticker = t.ticker AND a.session = t.session AND a.minute = 1330 LEFT JOIN b o ON o.ticker = t.ticker AND o.session = t.session AND o.minute = 0),
 st AS (SELECT *, close / CASE WHEN slot = 0 THEN session_open ELSE lag(close) OVER ({_PART}) END - 1 AS step FROM g),
 pc AS (SELECT ticker, session, last_value(a_close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_close FROM g WHERE slot = 0)"""


def _upto(f: str) -> str:
    return f"{f} OVER ({_PART} ROWS UNBOUNDED PRECEDING)"


def _last(f: str, n: int) -> str:
    return f"{f} OVER ({_PART} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _back(n: int) -> str:
    return f"CASE WHEN {_last('count(close)', n)} = {n} THEN close / CASE WHEN slot + 1 = {n} THEN session_open ELSE lag(close, {n}) OVER ({_PART}) END - 1 END"


def _moved(n: int) -> str:
    return f"CASE WHEN {_last('count(step)', n)} = {n} THEN {_last('sum(abs(step))', n)} END"


def _clock(keys: str, x: str, y: str) -> str:
    w = f"OVER (PARTITION BY {keys} ORDER BY session ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({x}) {w} >= 10 THEN {x} - quantile_cont({x}, 0.5) {w} END AS {y}"


_KNOWN = [
    "decision_price", "clock_fraction", "gap_open", "return_from_previous_close", "return_from_open", "return_1", "return_3", "return_6", "cumulative_range", "absolute_return_3", "absolute_return_6",
    "log_cumulative_volume", "log_cumulative_value", "log_recent_volume_1", "log_recent_volume_3", "price_to_vwap", "missing_fraction", *intraday.SHOCKS,
]
_SHOCK_SQL = ", ".join(_clock("ticker, minute", "ln(1 + 10000 * absolute_return_3)" if x.startswith("_") else x, y) for y, x in intraday.SHOCKS.items())


@register(
    "intraday_decisions",
    f"""WITH {_GRID}, f AS (SELECT *, slot * 120 + 120 AS minute, {_upto("count(close)")} AS known, {_upto("sum(volume)")} AS v, {_upto("sum((open + high + low + close) * 0.25 * volume)")} AS t, {_upto("max(high)")} AS h, {_upto("min(low)")} AS l,
 {_back(1)} AS return_1, {_back(3)} AS return_3, {_back(6)} AS return_6, {_moved(3)} AS absolute_return_3, {_moved(6)} AS absolute_return_6, CASE WHEN {_last("count(volume)", 3)} = 3 THEN ln(1 + {_last("sum(volume)", 3)}) END AS log_recent_volume_3,
 coalesce(slot - max(CASE WHEN close IS NOT NULL THEN slot END) OVER ({_PART} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1, slot) AS missing_since_previous FROM st),
 d AS (SELECT f.ticker, f.session, minute, close AS decision_price, minute / 1320.0 AS clock_fraction, session_open / previous_close - 1 AS gap_open, close / previous_close - 1 AS return_from_previous_close, close / session_open - 1 AS return_from_open,
 return_1, return_3, return_6, CASE WHEN known = slot + 1 THEN h / l - 1 END AS cumulative_range, absolute_return_3, absolute_return_6, CASE WHEN known = slot + 1 THEN ln(1 + v) END AS log_cumulative_volume, CASE WHEN known = slot + 1 THEN ln(1 + t) END AS log_cumulative_value,
 ln(1 + volume) AS log_recent_volume_1, log_recent_volume_3, CASE WHEN known = slot + 1 AND t > 0 THEN close / (t / nullif(v, 0)) - 1 END AS price_to_vwap, missing_since_previous, 1 - known / (slot + 1) AS missing_fraction
 FROM f JOIN pc ON f.ticker = pc.ticker AND f.session = pc.session WHERE minute BETWEEN {_START} AND {_END} AND session_open IS NOT NULL AND close IS NOT NULL), x AS (SELECT *, {_SHOCK_SQL} FROM d)
 SELECT ticker, session, minute, missing_since_previous, {s6(*_KNOWN)} FROM x""",
)
def intraday_decisions(spark, sf_dir):
    return intraday.decisions(session_bars(spark, sf_dir), HOURS, _START, _END).select("ticker", "session", "minute", "missing_since_previous", *r6(*_KNOWN))


def _path_sql(h: int) -> str:
    k = h // 120
    w = f"OVER ({_PART} ROWS BETWEEN 1 FOLLOWING AND {f'{k} FOLLOWING' if h else 'UNBOUNDED FOLLOWING'})"
    end = f"lead(close, {k}) OVER ({_PART})" if h else "a_close"
    # the path's bars and, for the close, the auction's as lists: first greatest and least by place
    return f"""SELECT ticker, session, minute, {h} AS horizon, close AS price, slot, {f"{h}.0" if h else "1330.0 - minute"} AS span, {end} AS e, count(close) {w} = {k if h else "10 - slot"} AND {end} IS NOT NULL AS whole,
 list(high) {w} AS hs, list(low) {w} AS ls, sum(abs(step)) {w} AS moved, sum(volume) {w} AS volume, a_high, a_low, a_volume, last_value(close IGNORE NULLS) OVER ({_PART} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS last, session_open FROM m"""


_TARGET_SQL = f"""{_GRID}, m AS (SELECT *, slot * 120 + 120 AS minute FROM st), p0 AS ({" UNION ALL ".join(_path_sql(h) for h in [*_HORIZONS, 0])}),
 p AS (SELECT *, CASE WHEN horizon = 0 THEN list_append(coalesce(hs, []), a_high) ELSE hs END AS hh, CASE WHEN horizon = 0 THEN list_append(coalesce(ls, []), a_low) ELSE ls END AS ll FROM p0 WHERE price IS NOT NULL AND session_open IS NOT NULL AND minute BETWEEN {_START} AND {_END}),
 q AS (SELECT ticker, session, minute, horizon, e / price - 1 AS endpoint_return, CASE WHEN whole THEN list_max(hh) / price - 1 END AS mfe, CASE WHEN whole THEN list_min(ll) / price - 1 END AS mae,
 CASE WHEN whole THEN coalesce(moved, 0) + CASE WHEN horizon = 0 THEN abs(e / last - 1) ELSE 0 END END AS absolute_return, CASE WHEN whole THEN greatest(list_max(hh), price) / least(list_min(ll), price) - 1 END AS future_range,
 CASE WHEN whole THEN CASE WHEN list_position(hh, list_max(hh)) = len(hh) THEN 1.0 ELSE list_position(hh, list_max(hh)) * 120 / span END END AS time_to_peak,
 CASE WHEN whole THEN CASE WHEN list_position(ll, list_min(ll)) = len(ll) THEN 1.0 ELSE list_position(ll, list_min(ll)) * 120 / span END END AS time_to_trough,
 CASE WHEN whole THEN ln(1 + coalesce(volume, 0) + CASE WHEN horizon = 0 THEN a_volume ELSE 0 END) END AS v FROM p),
 t AS (SELECT *, {_clock("ticker, minute, horizon", "v", "future_volume_shock")} FROM q)"""


@register("intraday_targets", f"WITH {_TARGET_SQL} SELECT ticker, session, minute, horizon, {s6(*intraday.TARGETS)} FROM t")
def intraday_targets(spark, sf_dir):
    t = intraday.path_targets(session_bars(spark, sf_dir), HOURS, _START, _END, _HORIZONS)
    return t.select("ticker", "session", "minute", "horizon", *r6(*intraday.TARGETS))


def _held(test: str, of: str = "endpoint_return") -> str:
    return f"avg(CASE WHEN {of} IS NOT NULL THEN ({test})::INT END)"


_R, _PATH = "endpoint_return", "endpoint_return IS NOT NULL AND mfe IS NOT NULL AND mae IS NOT NULL AND future_range IS NOT NULL"
_SETS = [
    (f"count({_R})", [f"median({_R})", f"avg({_R})", f"sqrt(avg({_R} ** 2))", f"avg(abs({_R}))", f"stddev_pop({_R})", _held(f"{_R} > 0"), _held(f"{_R} < 0"), _held(f"abs({_R}) >= 0.005"), f"CASE WHEN avg(abs({_R})) > 1e-12 THEN abs(avg({_R})) / avg(abs({_R})) ELSE 0 END"]),
    (f"count(*) FILTER ({_PATH})", [f"median({c}) FILTER ({_PATH})" for c in ("mfe", "mae", "future_range")] + [f"sqrt(avg({_R} ** 2 + 0.25 * future_range ** 2) FILTER ({_PATH}))"]),
    ("count(future_volume_shock)", ["median(future_volume_shock)", _held("future_volume_shock >= ln(1.5)", "future_volume_shock")]),
]
_SYSTEMIC_SQL = ", ".join(f"round(CASE WHEN {n} >= 4 THEN {x} END, 6) AS {name}" for name, (n, x) in zip(intraday.SYSTEMIC, [(n, x) for n, xs in _SETS for x in xs]))


@register("intraday_systemic", f"WITH {_TARGET_SQL} SELECT session, minute, horizon, {_SYSTEMIC_SQL} FROM t GROUP BY ALL")
def intraday_systemic(spark, sf_dir):
    t = intraday.path_targets(session_bars(spark, sf_dir), HOURS, _START, _END, _HORIZONS)
    return intraday.systemic_summary(t, 4).select("session", "minute", "horizon", *r6(*intraday.SYSTEMIC))


_EARLY = ("session_open", "decision_price", "early_return", "early_range", "absolute_return", "early_volume", "early_value", "coverage")


@register(
    "early_window",
    f"""WITH {_BARS}, e AS (SELECT *, close / coalesce(lag(close) OVER (PARTITION BY ticker, session ORDER BY minute), open) - 1 AS step FROM b WHERE minute + 120 <= 480)
 SELECT ticker, session, arg_min(open, minute) AS session_open, arg_max(close, minute) AS decision_price, round(arg_max(close, minute) / arg_min(open, minute) - 1, 6) AS early_return, round(max(high) / min(low) - 1, 6) AS early_range, round(sum(abs(step)), 6) AS absolute_return, round(sum(volume), 6) AS early_volume,
 round(sum((open + high + low + close) * 0.25 * volume), 6) AS early_value, round(count(*) / 4.0, 6) AS coverage, count(*) AS bars, CAST(4 AS BIGINT) AS expected_bars, count(*) = 4 AS complete FROM e GROUP BY ALL""",
)
def early_window(spark, sf_dir):
    return intraday.early_window(session_bars(spark, sf_dir), HOURS, 480).select("ticker", "session", *r6(*_EARLY), "bars", "expected_bars", "complete")


@register(
    "session_labels",
    f"WITH {_BARS} SELECT ticker, session, arg_max(close, minute) AS session_close, max(high) AS session_high, min(low) AS session_low, round(sum(volume), 6) AS session_volume, count(*) AS bars, max(minute) AS last_minute, max(minute) = 1330 AND count(*) = 12 AS complete FROM b GROUP BY ALL",
)
def session_labels(spark, sf_dir):
    got = intraday.session_labels(session_bars(spark, sf_dir), HOURS)
    return got.withColumn("session_volume", F.round("session_volume", 6))


_FIT = "1997-01-01"


@register(
    "residual_surprise",
    f"""WITH {DENSE}, u AS (UNPIVOT (SELECT date, ticker, return_1d, return_4d, CASE WHEN observed THEN ln(1 + volume) END AS log_volume FROM r) ON return_1d, return_4d, log_volume INTO NAME feature VALUE x),
 c AS (SELECT feature, median(x) AS m FROM u WHERE date < DATE '{_FIT}' GROUP BY feature), s0 AS (SELECT feature, first(m) AS center, 1.4826 * median(abs(x - m)) AS mad, sqrt(avg((x - m) ** 2)) AS rms FROM u JOIN c USING (feature) WHERE date < DATE '{_FIT}' GROUP BY feature),
 z AS (SELECT date AS step, ticker AS node, feature, least(greatest((x - center) / CASE WHEN mad >= 1e-6 THEN mad WHEN rms >= 1e-6 THEN rms ELSE 1 END, -8), 8) AS z FROM u JOIN s0 USING (feature)),
 f AS (SELECT step, feature, median(z) AS c FROM z GROUP BY ALL HAVING count(*) >= 8), k AS (SELECT step, count(*) AS nf, sqrt(avg(c * c)) AS common_energy, max((abs(c) > 1e-8)::INT) AS useful FROM f GROUP BY step),
 n AS (SELECT step, node, nf, common_energy, useful, count(*) AS cnt, sum(z * z) AS sq, avg(CASE WHEN abs(c) > 1e-8 THEN z * sign(c) END) AS along FROM z JOIN f USING (step, feature) JOIN k USING (step) GROUP BY step, node, nf, common_energy, useful),
 e AS (SELECT *, cnt >= greatest(1, ceil(nf * 0.25)) AS ok, sqrt(sq / cnt) AS en FROM n),
 s AS (SELECT step, first(common_energy) AS common_energy, first(useful) AS useful, sqrt(sum(sq) FILTER (ok) / sum(cnt) FILTER (ok)) AS total_energy, median(en) FILTER (ok) AS node_median, quantile_cont(en, 0.75) FILTER (ok) AS node_q75, avg((en >= 1)::INT) FILTER (ok) AS participation FROM e GROUP BY step HAVING count(*) FILTER (ok) >= 8),
 o AS (SELECT DISTINCT ticker FROM bars), ed AS (SELECT a.ticker AS src, b.ticker AS dst, CASE WHEN substr(a.ticker, 8, 1) < substr(b.ticker, 8, 1) THEN 1.0 ELSE -0.5 END AS w FROM o a JOIN o b ON substr(a.ticker, 7, 1) = substr(b.ticker, 7, 1) AND a.ticker <> b.ticker),
 ag AS (SELECT x.step, sum(sign(x.along) * sign(y.along) * w) / nullif(sum(abs(w)), 0) AS agreement FROM ed JOIN n x ON x.node = src JOIN n y ON y.node = dst AND y.step = x.step WHERE x.along IS NOT NULL AND y.along IS NOT NULL GROUP BY x.step)
 SELECT step, round(common_energy, 6) AS common_energy, round(total_energy, 6) AS total_energy, round(node_median, 6) AS node_median, round(node_q75, 6) AS node_q75, round(participation, 6) AS participation,
 round(CASE WHEN total_energy > 1e-12 THEN least(1, common_energy / total_energy) ELSE 0 END, 6) AS coherence, round(CASE WHEN useful = 0 THEN 0 ELSE agreement END, 6) AS edge_agreement, round(sqrt(common_energy ** 2 + node_median ** 2 * participation), 6) AS systemic_energy FROM s LEFT JOIN ag USING (step)""",
)
def residual_surprise(spark, sf_dir):
    r = with_returns(spark, sf_dir).select(F.col("date").alias("step"), F.col("ticker").alias("node"), "return_1d", "return_4d", F.when(F.col("observed"), F.log1p("volume")).alias("log_volume"))
    long = written(r.unpivot(["step", "node"], ["return_1d", "return_4d", "log_volume"], "feature", "residual").where("residual is not null"), "residuals")
    scales = conditions.robust_scale(long.where(F.col("step") < _FIT).withColumnRenamed("residual", "x"), "feature", "x")
    o = long.select("node").distinct()
    digit = lambda i: F.substring("node", i, 1)
    a, b = o.select(F.col("node").alias("src"), digit(7).alias("g"), digit(8).alias("_a")), o.select(F.col("node").alias("dst"), digit(7).alias("g"), digit(8).alias("_b"))
    edges = a.join(b, "g").where("src != dst").select("src", "dst", F.when(F.col("_a") < F.col("_b"), 1.0).otherwise(-0.5).alias("weight"))  # five brands a maker
    z = written(surprise.standardised(long, scales), "standardised")
    return surprise.residual_surprise(z, edges, 8).select("step", *r6(*surprise.SURPRISE))
