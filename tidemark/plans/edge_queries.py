"""Queries of edges by blocked products, and of sums that merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..operators import gram, panel, regression
from ..operators.frames import by
from ..sources.readers import parquet_table as table
from ..sources.shared import written
from .panel_queries import DENSE, _TARGET, r6, scored, with_returns


def _histories(spark, sf_dir, rows):
    return gram.histories(written(with_returns(spark, sf_dir).select("ticker", "date", "return_1d"), "panel"), "return_1d", rows)


def _history_sql(rows: int) -> str:
    return f"h AS (SELECT ticker, date, coalesce(return_1d, 0) AS x FROM r WHERE date IN (SELECT DISTINCT date FROM r ORDER BY date DESC LIMIT {rows}))"


@register(
    "lead_lag_edges",
    f"""WITH {DENSE}, {_history_sql(120)}, k AS (SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i, count(*) OVER (PARTITION BY ticker) AS n, x FROM h),
 a AS (SELECT *, count(*) OVER t AS m, avg(x) OVER t AS mean, stddev_pop(x) OVER t AS s FROM k WHERE i < n WINDOW t AS (PARTITION BY ticker)),
 b AS (SELECT *, avg(x) OVER t AS mean, stddev_pop(x) OVER t AS s FROM k WHERE i > 1 WINDOW t AS (PARTITION BY ticker)),
 w AS (SELECT a.ticker AS src, b.ticker AS dst, round_even(sum((a.x - a.mean) / a.s * (b.x - b.mean) / b.s) / (max(a.m) - 1), 4) AS w FROM a JOIN b ON b.i = a.i + 1 AND a.ticker <> b.ticker WHERE a.s > 1e-8 AND b.s > 1e-8 GROUP BY ALL)
 SELECT src, dst, round(w * 0.5, 6) AS weight FROM w WHERE abs(w) >= 0.08 QUALIFY row_number() OVER (PARTITION BY src ORDER BY abs(w) DESC, dst DESC) <= 3""",
)
def lead_lag_edges(spark, sf_dir):
    """Strongest correlations of each entity's return with the next row's return of others, over 120 sessions."""
    return gram.lead_lag_edges(_histories(spark, sf_dir, 120), 3).select("src", "dst", *r6("weight"))


@register("partial_correlation_edges")
def partial_correlation_edges(spark, sf_dir):
    """Of each entity the strongest partial correlations given all others; an inverse of the covariance, which SQL does not express."""
    return gram.partial_correlation_edges(_histories(spark, sf_dir, 61), 4).select("src", "dst", *r6("weight"))


_FACTORS = """u AS (SELECT l_returnflag || l_linestatus AS factor, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, avg(l_extendedprice / l_quantity) AS p FROM lineitem GROUP BY ALL),
 g AS (SELECT factor, d.date, coalesce(p / lag(p) OVER (PARTITION BY factor ORDER BY d.date) - 1, 0) AS x FROM (SELECT DISTINCT factor FROM u) CROSS JOIN (SELECT DISTINCT date FROM h) d LEFT JOIN u USING (factor, date))"""


def _factor_histories(spark, sf_dir, dates):
    """Weekly change of the mean price of each kind of line, on the dates of the stocks' histories."""
    u = table(spark, sf_dir, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("ticker"), F.date_trunc("week", "l_shipdate").cast("date").alias("date")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("p"))
    names = u.agg(F.collect_set("ticker").alias("names"))  # one row of a few names
    grid = dates.join(F.broadcast(names), F.lit(True)).select(F.explode("names").alias("ticker"), "date").join(u, ["ticker", "date"], "left")
    return gram.histories(grid.withColumn("x", F.col("p") / F.lag("p").over(by()) - 1), "x", 61)


@register(
    "factor_sensitivity_edges",
    f"""WITH {DENSE}, {_history_sql(61)}, {_FACTORS},
 a AS (SELECT *, avg(x) OVER f AS mean, stddev_pop(x) OVER f AS s, count(*) OVER f AS n FROM g WINDOW f AS (PARTITION BY factor)), b AS (SELECT *, avg(x) OVER t AS mean, stddev_pop(x) OVER t AS s FROM h WINDOW t AS (PARTITION BY ticker)),
 w AS (SELECT factor AS src, ticker AS dst, round_even(greatest(least(sum((a.x - a.mean) / a.s * (b.x - b.mean) / b.s) / (max(n) - 1), 1), -1), 4) AS w FROM a JOIN b USING (date) WHERE a.s > 1e-8 AND b.s > 1e-8 GROUP BY ALL)
 SELECT src, dst, round(w * 0.5, 6) AS weight FROM w WHERE abs(w) >= 0.15 QUALIFY row_number() OVER (PARTITION BY src ORDER BY abs(w) DESC, dst DESC) <= 5""",
)
def factor_sensitivity_edges(spark, sf_dir):
    p = written(with_returns(spark, sf_dir).select("ticker", "date", "return_1d"), "panel")
    dates = p.select("date").distinct().orderBy(F.desc("date")).limit(61)
    return gram.factor_edges(_factor_histories(spark, sf_dir, dates), gram.histories(p, "return_1d", 61), 5).select("src", "dst", *r6("weight"))


@register(
    "forecast_metrics",
    f"""WITH {_TARGET}, p AS (SELECT ticker, return_4d AS p, target_return AS t FROM t WHERE return_4d IS NOT NULL AND target_return IS NOT NULL)
 SELECT ticker, count(*) AS count, CASE WHEN count(*) >= 3 THEN round(avg(abs(p - t)), 6) END AS mae, CASE WHEN count(*) >= 3 THEN round(avg((p - t) ** 2), 6) END AS mse, CASE WHEN count(*) >= 3 THEN round(corr(p, t), 6) END AS pearson,
 CASE WHEN count(*) >= 3 THEN round(1 - sum((p - t) ** 2) / sum(t ** 2), 6) END AS skill_vs_zero_mse, CASE WHEN count(*) >= 3 THEN round(count(*) FILTER (WHERE t <> 0 AND sign(p) = sign(t)) / count(*) FILTER (WHERE t <> 0), 6) END AS direction_accuracy FROM p GROUP BY ticker""",
)
def forecast_metrics(spark, sf_dir):
    """Sums by entity and year, merged to entities."""
    s = regression.forecast_state(scored(spark, sf_dir).withColumn("year", F.year("date")), ["ticker", "year"], "return_4d", "target_return")
    m = regression.forecast_metrics(regression.merged_state(s, ["ticker"]), ["ticker"])
    return m.select("ticker", "count", *r6("mae", "mse", "pearson", "skill_vs_zero_mse", "direction_accuracy"))


@register(
    "factor_loadings",
    f"""WITH {DENSE}, m AS (SELECT ticker, return_1d AS y, avg(return_1d) OVER (PARTITION BY date) AS a, lag(return_1d) OVER (PARTITION BY ticker ORDER BY date) AS b FROM r),
 s AS (SELECT ticker, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS byy, var_pop(y) AS yy FROM m WHERE a IS NOT NULL AND b IS NOT NULL AND y IS NOT NULL GROUP BY ticker),
 c AS (SELECT *, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS c1, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS c2 FROM s)
 SELECT ticker, n, round(my - c1 * ma - c2 * mb, 6) AS intercept, round(c1, 6) AS market, round(c2, 6) AS momentum, round((c1 * ay + c2 * byy) / yy, 6) AS r2 FROM c""",
)
def factor_loadings(spark, sf_dir):
    """Each entity's return on the market's and its own last one; normal equations by entity and year, merged and solved by entity."""
    rows = panel.with_market(with_returns(spark, sf_dir)).withColumns({"last": F.lag("return_1d").over(by()), "year": F.year("date")})
    s = regression.merged_normal(regression.normal_state(rows, ["ticker", "year"], ["market", "last"], "return_1d"), ["ticker"], 2)
    c = regression.solved(s, ["ticker"], 2)
    return c.select("ticker", "n", *[F.round(F.col("coefficients")[i], 6).alias(k) for i, k in enumerate(("intercept", "market", "momentum"))], *r6("r2"))
