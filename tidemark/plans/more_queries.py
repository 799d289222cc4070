"""Queries for filings-like series, lifecycles, selections and combinations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import register
from ..operators import fundamentals as fu
from ..operators import panel
from ..sources.readers import parquet_table as table
from .panel_queries import DENSE, _TARGET, r6, s6, scored, with_returns

_QUARTERS = """q AS (SELECT c_nationkey AS nation, CAST(year(o_orderdate) AS INT) AS year, CAST(quarter(o_orderdate) AS INT) AS quarter, sum(o_totalprice) AS x FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
 f AS (SELECT nation, year, quarter, CASE WHEN quarter = 4 THEN sum(x) OVER (PARTITION BY nation, year) ELSE x END AS x FROM q)"""


def _filings(spark, sf_dir):
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    q = j.groupBy(F.col("c_nationkey").alias("nation"), F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")).agg(F.sum("o_totalprice").alias("x"))
    return q.withColumn("x", F.when(F.col("quarter") == 4, F.sum("x").over(Window.partitionBy("nation", "year"))).otherwise(F.col("x")))


_DISCRETE = _QUARTERS + """, d AS (SELECT nation, year, quarter, CASE WHEN quarter < 4 THEN x WHEN count(CASE WHEN quarter < 4 THEN x END) OVER w = 3 THEN x - sum(CASE WHEN quarter < 4 THEN x END) OVER w END AS discrete FROM f WINDOW w AS (PARTITION BY nation, year))"""


@register("discrete_quarters", f"WITH {_DISCRETE} SELECT nation, year, quarter, round(discrete, 2) AS discrete FROM d")
def discrete_quarters(spark, sf_dir):
    return fu.discrete_quarters(_filings(spark, sf_dir), "nation", "x").select("nation", "year", "quarter", F.round("discrete", 2).alias("discrete"))


@register("year_on_year", f"WITH {_DISCRETE} SELECT a.nation, a.year, a.quarter, round(a.discrete / nullif(abs(b.discrete), 0) - sign(b.discrete), 6) AS yoy FROM d a LEFT JOIN d b ON a.nation = b.nation AND a.year = b.year + 1 AND a.quarter = b.quarter")
def year_on_year(spark, sf_dir):
    d = fu.discrete_quarters(_filings(spark, sf_dir), "nation", "x").select("nation", "year", "quarter", "discrete")
    return fu.year_on_year(d, "nation", "discrete").select("nation", "year", "quarter", *r6("yoy"))


@register(
    "standard_surprise",
    f"WITH {_DISCRETE}, c AS (SELECT *, discrete - lag(discrete, 4) OVER (PARTITION BY nation ORDER BY year, quarter) AS ch FROM d) SELECT nation, year, quarter, round(CASE WHEN ch IS NOT NULL AND count(ch) OVER w >= 4 AND stddev_pop(ch) OVER w > 1e-12 THEN greatest(least(ch / stddev_pop(ch) OVER w, 10), -10) END, 6) AS surprise FROM c WINDOW w AS (PARTITION BY nation ORDER BY year, quarter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
)
def standard_surprise(spark, sf_dir):
    d = fu.discrete_quarters(_filings(spark, sf_dir), "nation", "x").select("nation", "year", "quarter", "discrete")
    return fu.standard_surprise(d, "nation", ["year", "quarter"], "discrete").select("nation", "year", "quarter", *r6("surprise"))


@register(
    "days_since_change",
    f"WITH {DENSE}, g AS (SELECT ticker, date, CASE WHEN return_1d > 0 THEN 1 ELSE 0 END AS up FROM r), n AS (SELECT *, CASE WHEN up IS NOT DISTINCT FROM lag(up) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM g WINDOW w AS (PARTITION BY ticker ORDER BY date)), k AS (SELECT *, sum(new) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS run FROM n) SELECT ticker, date, row_number() OVER (PARTITION BY ticker, run ORDER BY date) - 1 AS since FROM k",
)
def days_since_change(spark, sf_dir):
    g = with_returns(spark, sf_dir).select("ticker", "date", F.when(F.col("return_1d") > 0, 1).otherwise(0).alias("up"))
    return fu.days_since_change(g, "ticker", "date", "up").select("ticker", "date", "since")


@register(
    "merged_intervals",
    """WITH s AS (SELECT user_id, ts AS s, ts + INTERVAL 8 HOUR AS e FROM events), n AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) OR row_number() OVER (PARTITION BY user_id ORDER BY s, e) = 1 THEN 1 ELSE 0 END AS new FROM s),
 g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM n) SELECT user_id, min(s) AS start, max(e) AS "end", count(*) AS parts FROM g GROUP BY user_id, g""",
)
def merged_intervals(spark, sf_dir):
    s = table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("s"), (F.col("ts") + F.expr("INTERVAL 8 HOUR")).alias("e"))
    return fu.merged_intervals(s, "user_id", "s", "e")


@register(
    "lifecycle_universe",
    "WITH c AS (SELECT o_custkey AS k, min(o_orderdate) AS listed, CASE WHEN count(*) % 3 = 0 THEN max(o_orderdate) END AS delisted, o_orderpriority AS market FROM orders GROUP BY o_custkey, o_orderpriority) SELECT k, market, listed FROM c WHERE listed <= TIMESTAMP '1998-01-01' AND (delisted IS NULL OR delisted >= TIMESTAMP '1998-01-01') AND NOT regexp_matches(market, '^5') QUALIFY row_number() OVER (PARTITION BY k ORDER BY listed DESC, delisted DESC NULLS FIRST, market) = 1",
)
def lifecycle_universe(spark, sf_dir):
    c = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("market")).agg(F.min("o_orderdate").alias("listed"), F.when(F.count("*") % 3 == 0, F.max("o_orderdate")).alias("delisted"))
    at = F.lit("1998-01-01").cast("timestamp_ntz")
    return fu.latest_listing(c, "k", "listed", "delisted", at, ~F.col("market").rlike("^5"), ["market"]).select("k", "market", "listed")


@register("factor_jumps", f"WITH {DENSE}, f AS (SELECT ticker, date, close, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS factor_before FROM panel) SELECT ticker, date, {s6('close', 'factor_before')} FROM f WHERE abs(close / nullif(factor_before, 0) - 1) >= 2.0")
def factor_jumps(spark, sf_dir):
    return fu.factor_jumps(with_returns(spark, sf_dir), "ticker", "date", "close", 2.0).select("ticker", "date", *r6("close", "factor_before"))


@register(
    "seed_ensemble",
    "WITH p AS (SELECT user_id, CAST(ts AS DATE) AS date, event_id % 2 AS seed, value FROM events) SELECT user_id, date, round(avg(value), 6) AS mean FROM p GROUP BY ALL HAVING count(DISTINCT seed) = 2",
)
def seed_ensemble(spark, sf_dir):
    p = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").alias("date"), (F.col("event_id") % 2).alias("seed"), "value")
    return fu.ensemble(p, ["user_id", "date"], "seed", "value", 2).select("user_id", "date", *r6("mean"))


@register(
    "compounded_rate",
    "WITH c AS (SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) / 100000 AS rate FROM orders GROUP BY 1) SELECT day, round(CASE WHEN count(rate) OVER w = 5 AND date_diff('day', day, max(day) OVER w) = 5 THEN exp(sum(ln(1 + rate / 100) / 365) OVER w) - 1 END, 9) AS growth FROM c WINDOW w AS (ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)",
)
def compounded_rate(spark, sf_dir):
    c = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg((F.avg("o_totalprice") / 100000).alias("rate"))
    return fu.compounded(c, "day", "rate", 5).select("day", F.round("growth", 9).alias("growth"))


@register(
    "top_fraction_and_threshold",
    f"WITH {DENSE}, s AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY return_4d DESC, ticker) AS i, count(*) OVER (PARTITION BY date) AS n, quantile_cont(return_4d, 0.8) OVER (PARTITION BY date) AS q FROM r WHERE return_4d IS NOT NULL) SELECT date, count(*) FILTER (WHERE i <= greatest(1, floor(n * 0.2))) AS top_fraction, count(*) FILTER (WHERE return_4d >= q) AS above_threshold FROM s GROUP BY date",
)
def top_fraction_and_threshold(spark, sf_dir):
    d = Window.partitionBy("date")
    s = with_returns(spark, sf_dir).where("return_4d is not null").withColumns({"i": F.row_number().over(d.orderBy(F.desc("return_4d"), "ticker")), "n": F.count("*").over(d), "q": F.percentile("return_4d", 0.8).over(d)})
    return s.groupBy("date").agg(F.count_if(F.col("i") <= F.greatest(F.lit(1), F.floor(F.col("n") * 0.2))).alias("top_fraction"), F.count_if(F.col("return_4d") >= F.col("q")).alias("above_threshold"))


@register(
    "combined_score",
    f"""WITH {DENSE}, z AS (SELECT ticker, date, CASE WHEN count(return_4d) OVER d >= 3 AND stddev_pop(return_4d) OVER d > 0 THEN (return_4d - avg(return_4d) OVER d) / stddev_pop(return_4d) OVER d END AS a, CASE WHEN count(value) OVER d >= 3 AND stddev_pop(value) OVER d > 0 THEN (value - avg(value) OVER d) / stddev_pop(value) OVER d END AS b FROM r WINDOW d AS (PARTITION BY date))
 SELECT ticker, date, round(CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN 0.7 * coalesce(a, 0) + 0.3 * coalesce(b, 0) END, 6) AS score FROM z""",
)
def combined_score(spark, sf_dir):
    """Weighted sum of within-date z-scores; null if all parts are."""
    d = Window.partitionBy("date")
    z = lambda x: F.when((F.count(x).over(d) >= 3) & (F.stddev_pop(x).over(d) > 0), (F.col(x) - F.avg(x).over(d)) / F.stddev_pop(x).over(d))
    p = with_returns(spark, sf_dir).withColumns({"a": z("return_4d"), "b": z("value")})
    s = F.when(F.col("a").isNotNull() | F.col("b").isNotNull(), 0.7 * F.coalesce("a", F.lit(0.0)) + 0.3 * F.coalesce("b", F.lit(0.0)))
    return p.select("ticker", "date", F.round(s, 6).alias("score"))


@register(
    "pooled_skill",
    f"WITH {_TARGET} SELECT round(1 - sum((target_return - return_4d) ** 2) / nullif(sum(target_return ** 2), 0), 6) AS skill, count(*) AS n FROM t WHERE target_return IS NOT NULL AND return_4d IS NOT NULL",
)
def pooled_skill(spark, sf_dir):
    """1 less the squared error of a forecast over that of forecasting nothing."""
    p = scored(spark, sf_dir).where("target_return is not null and return_4d is not null")
    e, z = F.sum(F.pow(F.col("target_return") - F.col("return_4d"), 2)), F.sum(F.pow("target_return", 2))
    return p.agg(F.round(1 - F.try_divide(e, z), 6).alias("skill"), F.count("*").alias("n"))


@register(
    "calibration_fit",
    f"WITH {DENSE}, m AS (SELECT date, avg(abs(return_1d)) AS x FROM r WHERE return_1d IS NOT NULL GROUP BY date) SELECT count(*) AS n, round(quantile_cont(x, 0.5), 6) AS centre, round(CASE WHEN quantile_cont(x, 0.9) - quantile_cont(x, 0.5) > 1e-9 THEN quantile_cont(x, 0.9) - quantile_cont(x, 0.5) ELSE stddev_pop(x) END, 6) AS scale FROM m HAVING count(*) >= 20",
)
def calibration_fit(spark, sf_dir):
    """Centre and scale of a component: median, and the 0.9 quantile less it, or the deviation where that is nil."""
    m = with_returns(spark, sf_dir).where("return_1d is not null").groupBy("date").agg(F.avg(F.abs("return_1d")).alias("x"))
    mid, high = F.percentile("x", 0.5), F.percentile("x", 0.9)
    return m.agg(F.count("*").alias("n"), F.round(mid, 6).alias("centre"), F.round(F.when(high - mid > 1e-9, high - mid).otherwise(F.stddev_pop("x")), 6).alias("scale")).where("n >= 20")


@register("block_bootstrap")
def block_bootstrap(spark, sf_dir):
    """Mean of the daily market return with a 90 % interval from 200 circular block draws.

    Draws are dealt over tasks; the series (one value a session) goes to each."""
    m = panel.with_market(with_returns(spark, sf_dir)).groupBy("date").agg(F.max("market").alias("x")).where("x is not null")
    series = m.agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "x"))), lambda s: s["x"]).alias("v"))
    draws = spark.range(200).join(F.broadcast(series), F.lit(True))

    def run(frames):
        for pdf in frames:
            out = []
            for i, v in zip(pdf["id"], pdf["v"], strict=True):
                v = np.asarray(v)
                rng = np.random.default_rng(int(i))
                starts = rng.integers(0, len(v), -(-len(v) // 10))
                out.append(v[(starts[:, None] + np.arange(10)).ravel()[: len(v)] % len(v)].mean())
            yield pd.DataFrame({"mean": out})

    d = draws.mapInPandas(run, "mean double")
    return d.agg(F.round(F.avg("mean"), 6).alias("mean"), F.round(F.percentile("mean", 0.05), 6).alias("low"), F.round(F.percentile("mean", 0.95), 6).alias("high"))
