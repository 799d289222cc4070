"""Queries of state: edges that decay, forecasts that mature, releases that extend each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..operators import causal, edge_state, panel, residuals
from ..sources.readers import parquet_table as table
from ..sources.shared import written
from ..streaming import ordered, replay
from .panel_queries import BARS, DENSE, dense, r6, s6, weekly

_EDGES = """d AS (SELECT user_id % 20 AS src, event_type AS dst, CAST(ts AS DATE) AS day, sum((value - 10) / 50 * (event_id % 10) / 10) AS x FROM events GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY day) AS i FROM d),
 q AS (SELECT src, dst, day, i, CAST(x AS DOUBLE) AS weight FROM n WHERE i = 1 UNION ALL
  SELECT n.src, n.dst, n.day, n.i, n.x + CASE WHEN abs(q.weight * 0.02 ** (n.day - q.day)) >= 1e-4 THEN q.weight * 0.02 ** (n.day - q.day) ELSE 0 END FROM q JOIN n ON n.src = q.src AND n.dst = q.dst AND n.i = q.i + 1)"""


def _deltas(e):
    amount = (F.col("value") - 10) / 50 * (F.col("event_id") % 10) / 10
    return e.select((F.col("user_id") % 20).alias("src"), F.col("event_type").alias("dst"), F.col("ts").cast("timestamp").alias("ts"), amount.alias("amount"))


@register("edge_history", f"WITH RECURSIVE {_EDGES} SELECT src, dst, day, round(weight, 6) AS weight FROM q")
def edge_history(spark, sf_dir):
    d = _deltas(table(spark, sf_dir, "events")).withColumn("day", F.col("ts").cast("date"))
    return edge_state.edge_history(d, ["src", "dst"], "day", "amount", 0.02).select("src", "dst", "day", *r6("weight"))


@register(
    "edges_on_day",
    f"WITH RECURSIVE {_EDGES}, l AS (SELECT src, dst, arg_max(weight, day) AS w, max(day) AS day FROM q WHERE day <= DATE '2024-01-20' GROUP BY ALL), e AS (SELECT src, dst, w * 0.02 ** (DATE '2024-01-20' - day) AS weight, day FROM l) SELECT src, dst, round(weight, 6) AS weight FROM e WHERE day = DATE '2024-01-20' OR abs(weight) >= 1e-4",
)
def edges_on_day(spark, sf_dir):
    d = _deltas(table(spark, sf_dir, "events")).withColumn("day", F.col("ts").cast("date"))
    h = edge_state.edge_history(d, ["src", "dst"], "day", "amount", 0.02)
    return edge_state.edges_on(h, ["src", "dst"], "day", F.to_date(F.lit("2024-01-20")), 0.02).select("src", "dst", *r6("weight"))


@register("stream_edge_store", f"WITH RECURSIVE {_EDGES} SELECT src, dst, day, round(weight, 6) AS weight FROM q WHERE day + 1 <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY")
def stream_edge_store(spark, sf_dir):
    """The store as a stream that waits two days for late rows: the days that are final when its source ends."""
    s = _deltas(replay.table_stream(spark, sf_dir, "events"))
    got = replay.replayed(ordered.edge_store(s, ["src", "dst"], "ts", "amount", 0.02, "2 days"), "edges")
    return got.select("src", "dst", F.date_from_unix_date(F.col("period").cast("int")).alias("day"), *r6("weight"))


def _forecasts(spark, sf_dir):
    """Next week's return forecast by the last one, and what came, by week and entity."""
    p = dense(spark, sf_dir).withColumn("r", panel.change("close", 1))
    return p.select(F.lit("r").alias("feature"), F.datediff("date", F.to_date(F.lit("1992-01-06"))).alias("day"), "ticker", F.col("r").alias("target"), (0.5 * F.col("r")).alias("prediction")).withColumn("step", F.floor(F.col("day") / 7)).drop("day")


@register(
    "matured_corrections",
    f"""WITH RECURSIVE {DENSE}, f AS (SELECT CAST(floor(date_diff('day', DATE '1992-01-06', date) / 7) AS BIGINT) AS step, ticker, return_1d AS t, 0.5 * return_1d AS p FROM r),
 s AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY step) AS i, lag(step, 2) OVER (PARTITION BY ticker ORDER BY step) AS was FROM f),
 q AS (SELECT ticker, step, i, p, CAST(0 AS DOUBLE) AS m, p AS c, CAST(NULL AS DOUBLE) AS c1 FROM s WHERE i = 1
  UNION ALL SELECT s.ticker, s.step, s.i, s.p, CASE WHEN q.c1 IS NOT NULL AND s.was = s.step - 2 AND s.t IS NOT NULL THEN q.m + 0.3 * (greatest(-0.2, least(0.2, s.t - q.c1)) - q.m) ELSE q.m END AS m,
   s.p + greatest(-0.2, least(0.2, CASE WHEN q.c1 IS NOT NULL AND s.was = s.step - 2 AND s.t IS NOT NULL THEN q.m + 0.3 * (greatest(-0.2, least(0.2, s.t - q.c1)) - q.m) ELSE q.m END)), q.c FROM q JOIN s ON s.ticker = q.ticker AND s.i = q.i + 1)
 SELECT ticker, step, round(c, 6) AS corrected, round(m, 6) AS correction FROM q""",
)
def matured_corrections(spark, sf_dir):
    """Forecasts two weeks ahead, corrected by each entity's own matured errors."""
    rows = _forecasts(spark, sf_dir)
    got = residuals.corrected(rows, ["feature"], "step", "ticker", lambda: residuals.Innovation(2, 0.3, 1.0, 0.2), {"prediction": "prediction", "target": "target"})
    return got.select("ticker", "step", *r6("corrected", "correction"))


@register("online_residuals")
def online_residuals(spark, sf_dir):
    """Bias and gain of forecast errors over all entities; a sequence over weeks with moments of matured errors, which is tested against a loop."""
    rows = _forecasts(spark, sf_dir).withColumn("error", F.col("target") - F.col("prediction"))
    got = residuals.corrected(rows, ["feature"], "step", "ticker", lambda: residuals.OnlineResidual(2, 0.2, 0.05, 0.8, 0.1, 1e-6, 5), {"error": "error"})
    return got.select("ticker", "step", *r6("bias_correction", "correction"))


# a split that the vendor's adjusted prices know from June 1996 back, and a rescaling of the whole history by the later release
def _with_adjusted(bars, vendor):
    split = F.when(F.col("date") < "1996-06-03", 0.5).otherwise(1.0) * vendor
    return bars.withColumns({f"adjusted_{c}": F.col(c) * split for c in causal.PRICES} | {"adjusted_volume": F.col("volume") / split})


@register(
    "causal_extension",
    f"""WITH {BARS}, a AS (SELECT *, close * CASE WHEN date < DATE '1996-06-03' THEN 0.5 ELSE 1 END AS adjusted, first_value(close) OVER w AS c0 FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
 s AS (SELECT *, c0 * adjusted / first_value(adjusted) OVER (PARTITION BY ticker ORDER BY date) / close AS scale FROM a)
 SELECT ticker, date, round(scale, 6) AS scale, round(close * scale, 6) AS close, round(open * scale, 6) AS open, round(volume / scale, 6) AS volume, round(close, 6) AS raw_close FROM s""",
)
def causal_extension(spark, sf_dir):
    """A release up to 1997 extended by a later one, from the bridge on, whose adjusted prices are on another scale: as one build of all."""
    bars = written(weekly(spark, sf_dir), "bars")
    early = bars.where("date <= DATE '1997-01-06'")
    base = written(causal.causal_bars(_with_adjusted(early, 1.0)), "base")
    bridge = base.groupBy("ticker").agg(F.max("date").alias("_bridge"))
    late = bars.join(bridge, "ticker", "left").where("_bridge is null or date >= _bridge").drop("_bridge")
    return causal.extended(base, _with_adjusted(late, 0.9)).select("ticker", "date", *r6("scale", "close", "open", "volume", "raw_close"))


@register(
    "action_events",
    f"""WITH {BARS}, a AS (SELECT *, CASE WHEN date < DATE '1996-06-03' THEN 0.5 ELSE 1.0 END AS f FROM bars), l AS (SELECT *, lag(f) OVER w AS f0, close / lag(close) OVER w - 1 AS raw_return, close * f / lag(close * f) OVER w - 1 AS causal_return FROM a WINDOW w AS (PARTITION BY ticker ORDER BY date))
 SELECT ticker, date, round(f0, 6) AS factor_before, round(f, 6) AS factor_after, round(f0 / f, 6) AS action_ratio, true AS corroborated, {s6('raw_return', 'causal_return')} FROM l WHERE abs(f / f0 - 1) >= 0.02""",
)
def action_events(spark, sf_dir):
    e = causal.action_events(causal.causal_bars(_with_adjusted(weekly(spark, sf_dir), 1.0)))
    return e.select("ticker", "date", *r6("factor_before", "factor_after", "action_ratio"), "corroborated", *r6("raw_return", "causal_return"))
