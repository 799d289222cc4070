"""Queries of filing frames: the orders of each nation and segment as quarterly reports with amendments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..operators import filings as fi
from ..sources.readers import parquet_table as table
from .panel_queries import r6

# A quarter's report comes 20 to 44 days after it; fourth quarters hold the whole year; a third of reports is amended 70 days later, on a
# day on which the next report may come, and amendments leave fields out.
_ROWS = """o AS (SELECT c_nationkey * 10 + ascii(c_mktsegment) % 5 AS ticker, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q, o_totalprice AS x, o_orderstatus AS s FROM orders JOIN customer ON o_custkey = c_custkey),
 g AS (SELECT ticker, q, sum(x) AS revenue, count(*) AS n, sum(CASE s WHEN 'F' THEN x ELSE -0.5 * x END) AS op, sum(CASE s WHEN 'O' THEN x ELSE -0.4 * x END) AS net, max(x) AS assets, min(x) AS equity FROM o GROUP BY ALL),
 y AS (SELECT *, last_day(q + INTERVAL 2 MONTH) AS period_end, quarter(q) = 4 AS whole FROM g),
 a AS (SELECT ticker, q, n, period_end, whole, CASE WHEN whole THEN sum(revenue) OVER k ELSE revenue END AS revenue, CASE WHEN whole THEN sum(op) OVER k ELSE op END AS op, CASE WHEN whole THEN sum(net) OVER k ELSE net END AS net, assets, equity FROM y WINDOW k AS (PARTITION BY ticker, year(q))),
 filings AS (SELECT ticker, 0 AS seq, period_end, period_end + CAST(20 + n % 25 AS INT) AS available_at, revenue, CASE WHEN n % 7 <> 0 THEN op END AS operating_income, net AS net_income, assets, assets - equity AS liabilities, equity, assets / 3 AS cash, net / n AS eps, n * 1000.0 AS shares_outstanding, CASE WHEN n % 2 = 0 THEN n / 100 END AS dividend_per_share FROM a
  UNION ALL SELECT ticker, 1, period_end, period_end + CAST(90 + n % 45 AS INT), revenue * 1.1, NULL, net * 0.9, NULL, NULL, equity * 1.01, NULL, NULL, NULL, NULL FROM a WHERE n % 3 = 0)"""


def _filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") * 10 + F.ascii("c_mktsegment") % 5).alias("ticker"))
    o = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("ticker", F.date_trunc("quarter", "o_orderdate").cast("date").alias("q"), F.col("o_totalprice").alias("x"), F.col("o_orderstatus").alias("s"))
    g = o.groupBy("ticker", "q").agg(
        F.sum("x").alias("revenue"), F.count("*").alias("n"), F.sum(F.when(F.col("s") == "F", F.col("x")).otherwise(-0.5 * F.col("x"))).alias("op"),
        F.sum(F.when(F.col("s") == "O", F.col("x")).otherwise(-0.4 * F.col("x"))).alias("net"), F.max("x").alias("assets"), F.min("x").alias("equity"),
    )
    k = Window.partitionBy("ticker", F.year("q"))
    whole = F.quarter("q") == 4
    a = g.withColumns({x: F.when(whole, F.sum(x).over(k)).otherwise(F.col(x)) for x in ("revenue", "op", "net")} | {"period_end": F.last_day(F.add_months("q", 2))})
    n, none = F.col("n"), F.lit(None).cast("double")
    first = a.select(
        "ticker", F.lit(0).alias("seq"), "period_end", F.date_add("period_end", (20 + n % 25).cast("int")).alias("available_at"), "revenue", F.when(n % 7 != 0, F.col("op")).alias("operating_income"), F.col("net").alias("net_income"), "assets",
        (F.col("assets") - F.col("equity")).alias("liabilities"), "equity", (F.col("assets") / 3).alias("cash"), (F.col("net") / n).alias("eps"), (n * 1000.0).alias("shares_outstanding"), F.when(n % 2 == 0, n / 100).alias("dividend_per_share"),
    )
    late = {"revenue": F.col("revenue") * 1.1, "net_income": F.col("net") * 0.9, "equity": F.col("equity") * 1.01}
    amended = a.where(n % 3 == 0).select("ticker", F.lit(1).alias("seq"), "period_end", F.date_add("period_end", (90 + n % 45).cast("int")).alias("available_at"), *[late.get(c, none).alias(c) for c in fi.FIELDS])
    return first.unionByName(amended)


_LAST = ", ".join(f"arg_max({c}, (seq, period_end)) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("period_end", *fi.FIELDS))
_KNOWN = lambda years, quarter, c: f"(SELECT arg_max(v.{c}, (v.available_at, v.seq)) FROM filings v WHERE v.{c} IS NOT NULL AND v.ticker = d.ticker AND v.available_at <= d.available_at AND year(v.period_end) = year(d.period_end) - {years} AND quarter(v.period_end) = {quarter})"
_THREE = lambda years, c: " + ".join(_KNOWN(years, q, c) for q in (1, 2, 3))
_STATES = f"""{_ROWS}, d AS (SELECT ticker, available_at, {_LAST} FROM filings GROUP BY ticker, available_at),
 t AS (SELECT *, {", ".join(f"CASE WHEN quarter(period_end) = 4 THEN {c} - ({_THREE(0, c)}) ELSE {c} END AS three_{c}" for c in fi.FLOWS)},
  CASE WHEN quarter(period_end) = 4 THEN {_KNOWN(1, 4, "revenue")} - ({_THREE(1, "revenue")}) ELSE {_KNOWN(1, "quarter(d.period_end)", "revenue")} END AS year_ago FROM d),
 states AS (SELECT ticker, available_at, three_revenue AS revenue, three_operating_income AS operating_income, three_net_income AS net_income, three_eps AS eps, assets, equity, cash, shares_outstanding, dividend_per_share,
  three_revenue / nullif(year_ago, 0) - 1 AS revenue_yoy, operating_income / nullif(revenue, 0) AS operating_margin, net_income / nullif(revenue, 0) AS net_margin, equity / nullif(assets, 0) AS equity_to_assets, liabilities / nullif(equity, 0) AS liabilities_to_equity FROM t)"""
_VALUES = [source for source, _ in fi.FEATURES.values()]


_SIGNED = lambda x: f"sign({x}) * ln(1 + abs({x}))"
# fields are shown as signed logs, which have no ties when rounded
@register("filing_states", f"WITH {_STATES} SELECT ticker, available_at, {', '.join(f'round({_SIGNED(c) if c in fi.FIELDS else c}, 6) AS {c}' for c in _VALUES)} FROM states")
def filing_states(spark, sf_dir):
    return fi.filing_states(_filings(spark, sf_dir), ["seq", "period_end"]).select("ticker", "available_at", *[F.round(fi.signed_log(F.col(c)) if c in fi.FIELDS else F.col(c), 6).alias(c) for c in _VALUES])


_FEATURE_SQL = {name: (_SIGNED(s) if f is fi.signed_log else s if name.startswith(("fund_dividend", "fund_revenue_yoy", "fund_operating_margin", "fund_net_margin", "fund_equity_to", "fund_liab")) else f"ln(1 + greatest({s}, 0))") for name, (s, f) in fi.FEATURES.items()}
_FRAMES = f"""{_STATES}, dates AS (SELECT DISTINCT CAST(date_trunc('week', o_orderdate) AS DATE) AS date FROM orders),
 grid AS (SELECT ticker, date, lag(date) OVER (PARTITION BY ticker ORDER BY date) AS known_on FROM (SELECT DISTINCT ticker FROM o) CROSS JOIN dates),
 filled AS (SELECT ticker, available_at, {", ".join(f"last_value({c} IGNORE NULLS) OVER w AS {c}" for c in _VALUES)} FROM states WINDOW w AS (PARTITION BY ticker ORDER BY available_at)),
 frames AS (SELECT g.ticker, g.date, {", ".join(f"CASE WHEN {s} IS NOT NULL THEN {_FEATURE_SQL[n]} END AS {n}" for n, (s, _) in fi.FEATURES.items())}, date_diff('day', f.available_at, g.date) AS fund_report_age_days
  FROM grid g ASOF LEFT JOIN filled f ON g.ticker = f.ticker AND g.known_on >= f.available_at)"""


def _frames(spark, sf_dir):
    f = _filings(spark, sf_dir)
    dates = table(spark, sf_dir, "orders").select(F.date_trunc("week", "o_orderdate").cast("date").alias("date")).distinct()
    calendar = dates.agg(F.collect_set("date").alias("dates"))  # one row
    grid = f.select("ticker").distinct().join(F.broadcast(calendar), F.lit(True)).select("ticker", F.explode("dates").alias("date"))
    return fi.filing_frames(grid, f, ["seq", "period_end"])


@register("filing_frames", f"WITH {_FRAMES} SELECT ticker, date, {', '.join(f'round({n}, 6) AS {n}' for n in fi.FEATURES)}, fund_report_age_days FROM frames")
def filing_frames(spark, sf_dir):
    return _frames(spark, sf_dir).select("ticker", "date", *r6(*fi.FEATURES), F.col("fund_report_age_days").cast("long").alias("fund_report_age_days"))


_ALL = [*fi.FEATURES, "fund_report_age_days"]


@register("filing_coverage", f"WITH {_FRAMES} SELECT round(({' + '.join(f'count({n})' for n in _ALL)}) / (count(*) * ({' + '.join(f'CAST(count({n}) > 0 AS INT)' for n in _ALL)})), 6) AS coverage FROM frames WHERE date >= DATE '1996-01-01'")
def filing_coverage(spark, sf_dir):
    return fi.coverage(_frames(spark, sf_dir), F.col("date") >= "1996-01-01").select(F.round("coverage", 6).alias("coverage"))
