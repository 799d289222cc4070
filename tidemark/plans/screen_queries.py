"""Queries of screens, labels and small summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..operators import screens
from ..sources.readers import parquet_table as table
from ..sources.shared import written
from .panel_queries import BARS, DENSE, dense, r6, s6, weekly, with_returns


@register(
    "tradeable_top",
    f"""WITH {DENSE}, k AS (SELECT ticker, date, row_number() OVER (PARTITION BY date ORDER BY return_1d DESC, ticker DESC) AS place FROM r WHERE observed AND return_1d IS NOT NULL AND close BETWEEN 1000 AND 2000)
 SELECT ticker, date, place FROM k WHERE place <= 5""",
)
def tradeable_top(spark, sf_dir):
    return screens.tradeable(with_returns(spark, sf_dir), "return_1d", "close", 1000.0, 2000.0, 5).select("ticker", "date", "place")


@register(
    "near_halt_exclusion",
    f"WITH {DENSE}, q AS (SELECT ticker, date, close, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS b FROM panel) SELECT ticker, date, round(close, 6) AS close FROM q WHERE close <> b AND close >= 1100",
)
def near_halt_exclusion(spark, sf_dir):
    return screens.moved(dense(spark, sf_dir), "close", 1100.0).select("ticker", "date", *r6("close"))


@register(
    "complete_sessions",
    f"""WITH {DENSE}, p AS (SELECT date, count(*) FILTER (WHERE return_1d IS NOT NULL AND close > 0) AS observed FROM r GROUP BY date), q AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS step FROM p),
 m AS (SELECT max(observed) AS reference FROM (SELECT observed FROM p ORDER BY date DESC LIMIT 20)), t AS (SELECT reference, CAST(greatest(1, ceil(reference * 0.9)) AS BIGINT) AS threshold FROM m)
 SELECT date, step, observed, reference, threshold, round(observed / greatest(reference, 1), 6) AS coverage_ratio, (SELECT max(date) FROM p) AS panel_latest_date, (SELECT arg_max(observed, date) FROM p) AS panel_latest_observed
 FROM q CROSS JOIN t WHERE observed >= threshold ORDER BY date DESC LIMIT 1""",
)
def complete_sessions(spark, sf_dir):
    c = screens.latest_complete_session(written(with_returns(spark, sf_dir).select("date", "return_1d", "close"), "panel"))
    return c.select("date", F.col("step").cast("long").alias("step"), "observed", "reference", F.col("threshold").cast("long").alias("threshold"), *r6("coverage_ratio"), "panel_latest_date", "panel_latest_observed")


@register(
    "envelope_repair",
    f"""WITH {BARS}, b AS (SELECT ticker, date, open, high * 0.999 AS high, low * 1.001 AS low, close FROM bars), q AS (SELECT *, greatest(open, high, low, close) AS top, least(open, high, low, close) AS bottom FROM b),
 f AS (SELECT *, top > high OR bottom < low AS repaired, greatest(top - high, low - bottom) / abs(close) AS magnitude FROM q)
 SELECT ticker, date, repaired, round(magnitude, 6) AS magnitude, round(top, 6) AS high, round(bottom, 6) AS low, round(high, 6) AS vendor_high, max(magnitude) OVER t > 0.02 OR avg(CAST(repaired AS INT)) OVER t > 0.8 AS fault FROM f WINDOW t AS (PARTITION BY ticker)""",
)
def envelope_repair(spark, sf_dir):
    b = weekly(spark, sf_dir).withColumns({"high": F.col("high") * 0.999, "low": F.col("low") * 1.001})
    return screens.enveloped(b, 0.02, 0.8, fail=False).select("ticker", "date", "repaired", *r6("magnitude", "high", "low", "vendor_high"), "fault")


@register(
    "rank_bins",
    f"""WITH {DENSE}, k AS (SELECT ticker, date, row_number() OVER (PARTITION BY date ORDER BY return_1d, ticker) - 1 AS i, count(*) OVER (PARTITION BY date) AS n FROM r WHERE return_1d IS NOT NULL)
 SELECT ticker, date, CAST(least(i * 20 // n, 19) AS BIGINT) AS bin FROM k WHERE n >= 20""",
)
def rank_bins(spark, sf_dir):
    return screens.rank_bins(with_returns(spark, sf_dir), "return_1d", 20).select("ticker", "date", "bin")


_LAGS = range(1, 10)


@register(
    "return_lags",
    f"WITH {DENSE}, g AS (SELECT ticker, date, "
    + ", ".join(f"lag(return_1d, {k}) OVER w AS l{k}" for k in _LAGS)
    + " FROM r WINDOW w AS (PARTITION BY ticker ORDER BY date)), f AS (SELECT "
    + ", ".join(f"CASE WHEN count(l{k}) >= 100 THEN avg(l{k}) ELSE 0 END AS m{k}, CASE WHEN count(l{k}) >= 100 AND stddev_pop(l{k}) > 1e-9 THEN stddev_pop(l{k}) ELSE 1 END AS s{k}" for k in _LAGS)
    + " FROM g WHERE date <= DATE '1996-01-01') SELECT ticker, date, "
    + ", ".join(f"round(CASE WHEN l{k} IS NULL THEN 0 ELSE greatest(-5, least(5, (l{k} - m{k}) / s{k})) END, 6) AS return_1d_lag{k}, l{k} IS NOT NULL AS return_1d_lag{k}_known" for k in _LAGS)
    + " FROM g CROSS JOIN f",
)
def return_lags(spark, sf_dir):
    """Nine last returns, scaled by the rows up to 1996 only."""
    names = [f"return_1d_lag{k}" for k in _LAGS]
    raw = written(screens.lags(with_returns(spark, sf_dir), "return_1d", 9).select("ticker", "date", *names), "lags")
    return screens.train_scaled(raw, names, F.to_date(F.lit("1996-01-01"))).select("ticker", "date", *r6(*names), *[f"{n}_known" for n in names])


@register("sample_z", f"WITH {DENSE} SELECT ticker, date, round(coalesce((return_1d - avg(return_1d) OVER d) / nullif(stddev_samp(return_1d) OVER d, 0), 0), 6) AS z FROM r WINDOW d AS (PARTITION BY date)")
def sample_z(spark, sf_dir):
    return screens.sample_z(with_returns(spark, sf_dir), "return_1d").select("ticker", "date", *r6("z"))


_DAILY = "m AS (SELECT date, avg(return_1d) AS x FROM r GROUP BY date)"


def _daily(spark, sf_dir):
    return with_returns(spark, sf_dir).groupBy("date").agg(F.avg("return_1d").alias("x"))


@register(
    "drop_best_dates",
    f"WITH {DENSE}, {_DAILY}, k AS (SELECT x, row_number() OVER (ORDER BY x DESC, date) AS i FROM m WHERE x IS NOT NULL) SELECT round(avg(x), 9) AS mean, round(avg(x) FILTER (WHERE i > 5), 9) AS mean_without FROM k",
)
def drop_best_dates(spark, sf_dir):
    return screens.without_best(_daily(spark, sf_dir), "x", 5).select(F.round("mean", 9).alias("mean"), F.round("mean_without", 9).alias("mean_without"))


@register(
    "break_even_cost",
    f"""WITH {DENSE}, a AS (SELECT ticker, avg(return_1d) AS m, stddev_samp(return_1d) AS s, avg(return_4d) AS n, stddev_samp(return_4d) AS t FROM r GROUP BY ticker), k AS (SELECT *, sqrt(252 / 1) / s AS k, sqrt(252 / 4) / t AS l FROM a)
 SELECT ticker, round(CASE WHEN abs(k - l) > 1e-12 THEN (k * m - l * n) / (k - l) END, 6) AS cost FROM k""",
)
def break_even_cost(spark, sf_dir):
    """Of each entity, holding it for one session against four."""
    a = with_returns(spark, sf_dir).groupBy("ticker").agg(F.avg("return_1d").alias("m"), F.stddev_samp("return_1d").alias("s"), F.avg("return_4d").alias("n"), F.stddev_samp("return_4d").alias("t"))
    return a.select("ticker", F.round(screens.break_even((F.col("m"), F.col("s"), 1.0), (F.col("n"), F.col("t"), 4.0)), 6).alias("cost"))


@register(
    "historical_stress",
    f"""WITH {DENSE}, m AS (SELECT date, return_1d AS x, median(return_1d) OVER (PARTITION BY date) AS mid FROM r WHERE return_1d IS NOT NULL),
 d AS (SELECT date, abs(max(mid)) + median(abs(x - mid)) + 0.02 * abs(avg(CAST(x < 0 AS INT)) - 0.5) AS s FROM m GROUP BY date HAVING count(*) >= 20)
 SELECT date, round(s, 6) AS realized_stress, round(CASE WHEN count(s) OVER w >= 5 THEN avg(s) OVER w END + CASE WHEN count(s) OVER v >= 5 THEN max(s) OVER v END, 6) AS risk_score FROM d
 WINDOW w AS (ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), v AS (ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""",
)
def historical_stress(spark, sf_dir):
    return screens.stress(with_returns(spark, sf_dir), "return_1d", 20).select("date", *r6("realized_stress", "risk_score"))


@register(
    "rolling_sums",
    f"WITH {DENSE} SELECT ticker, date, round(sum(volume) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS volume_3, round(sum(volume) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS volume_10 FROM panel",
)
def rolling_sums(spark, sf_dir):
    return screens.sums(dense(spark, sf_dir), "volume", (3, 10)).select("ticker", "date", *r6("volume_3", "volume_10"))


@register(
    "calendar_arithmetic",
    """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INT) AS e FROM orders)
 SELECT o_orderkey, last_day(d + INTERVAL 3 MONTH) AS quarter_end, CASE WHEN e - d > 1 THEN len(list_filter(generate_series(d + 1, e - 1, INTERVAL 1 DAY), lambda x: isodow(x) < 6)) ELSE 0 END AS weekdays,
 round((year(d) - 2020) / 10, 6) AS year_code, round(sin(2 * pi() * (month(d) - 1) / 12), 6) AS month_sin, round(cos(2 * pi() * (month(d) - 1) / 12), 6) AS month_cos,
 round(sin(2 * pi() * (isodow(d) - 1) / 5), 6) AS week_sin, round(cos(2 * pi() * (isodow(d) - 1) / 5), 6) AS week_cos FROM o""",
)
def calendar_arithmetic(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    o = o.withColumn("e", F.date_add("d", (F.col("o_orderkey") % 30).cast("int")))
    codes = [F.round(x, 6).alias(k) for k, x in screens.calendar_codes(F.col("d")).items()]
    return o.select("o_orderkey", screens.next_quarter_end(F.col("d")).alias("quarter_end"), screens.business_days(F.col("d"), F.col("e")).alias("weekdays"), *codes)


_PAIR = "z AS (SELECT ticker, date, lag(return_1d) OVER (PARTITION BY ticker ORDER BY date) AS p, return_1d AS t FROM r), y AS (SELECT * FROM z WHERE p IS NOT NULL AND t IS NOT NULL)"


def _pairs(spark, sf_dir):
    return screens.lags(with_returns(spark, sf_dir), "return_1d", 1)


@register(
    "demeaned_skill",
    f"""WITH {DENSE}, {_PAIR}, c AS (SELECT date, p - avg(p) OVER d AS p, t - avg(t) OVER d AS t FROM y WINDOW d AS (PARTITION BY date)),
 g AS (SELECT date, count(*) AS cells, sum(p * p) AS prediction_sse, sum(t * t) AS target_sse, sum(p * t) AS "cross", sum((p - t) ** 2) AS model_sse FROM c GROUP BY date HAVING count(*) >= 3)
 SELECT date, cells, round(prediction_sse, 6) AS prediction_sse, round(target_sse, 6) AS target_sse, round("cross", 6) AS "cross", round(model_sse, 6) AS model_sse, round(CASE WHEN target_sse > 1e-12 THEN 1 - model_sse / target_sse END, 6) AS skill FROM g""",
)
def demeaned_skill(spark, sf_dir):
    return screens.demeaned_skill(_pairs(spark, sf_dir), "return_1d_lag1", "return_1d").select("date", "cells", *r6("prediction_sse", "target_sse", "cross", "model_sse", "skill"))


@register(
    "weighted_correlation",
    f"""WITH {DENSE}, {_PAIR}, w AS (SELECT date, p, t, abs(t) / nullif(sum(abs(t)) OVER d, 0) AS w FROM y WINDOW d AS (PARTITION BY date)), c AS (SELECT date, w, p - sum(w * p) OVER d AS p, t - sum(w * t) OVER d AS t FROM w WINDOW d AS (PARTITION BY date))
 SELECT date, round(CASE WHEN count(*) >= 2 AND sum(w * p * p) > 0 AND sum(w * t * t) > 0 THEN sum(w * p * t) / sqrt(sum(w * p * p) * sum(w * t * t)) END, 6) AS correlation FROM c GROUP BY date""",
)
def weighted_correlation(spark, sf_dir):
    return screens.weighted_correlation(_pairs(spark, sf_dir), "return_1d_lag1", "return_1d", "date").select("date", *r6("correlation"))


@register(
    "universe_mean_return",
    f"WITH {DENSE}, c AS (SELECT date, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS c FROM panel WHERE close IS NOT NULL) SELECT date, count(c) AS n, {s6('avg(c)').replace('AS avg(c)', 'AS mean')} FROM c GROUP BY date HAVING count(c) >= 20",
)
def universe_mean_return(spark, sf_dir):
    return screens.universe_mean(dense(spark, sf_dir), "close", 20).select("date", "n", *r6("mean"))
