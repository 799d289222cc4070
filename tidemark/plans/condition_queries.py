"""Queries of market conditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..operators import conditions
from ..operators.frames import by
from ..sources.readers import parquet_table as table
from .panel_queries import BARS, DENSE, dense, r6, s6, weekly, with_returns

# a factor: the price of each order priority by day, filled where a priority has no orders
_FACTOR = """days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), names AS (SELECT DISTINCT o_orderpriority AS factor FROM orders),
 raw AS (SELECT o_orderpriority AS factor, CAST(o_orderdate AS DATE) AS date, {value} AS x FROM orders GROUP BY 1, 2),
 j AS (SELECT factor, date, last_value(x IGNORE NULLS) OVER (PARTITION BY factor ORDER BY date) AS x FROM names CROSS JOIN days LEFT JOIN raw USING (factor, date)),
 a AS (SELECT factor, date, {late} AS x FROM j)"""


def _factor(spark, sf_dir, value, lag):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("factor"), F.col("o_orderdate").cast("date").alias("date"), "o_totalprice")
    names = o.agg(F.array_sort(F.collect_set("factor")).alias("names"))  # one row: the names of factors
    grid = o.select("date").distinct().crossJoin(F.broadcast(names)).select(F.explode("names").alias("factor"), "date")
    raw = o.groupBy("factor", "date").agg(value.alias("x"))
    return conditions.align(grid, raw, "x", lag)


@register(
    "market_factor_features",
    "WITH "
    + _FACTOR.format(value="avg(o_totalprice)", late="lag(x) OVER (PARTITION BY factor ORDER BY date)")
    + """, b AS (SELECT *, x / nullif(lag(x, 1) OVER w, 0) - 1 AS ret1, x / nullif(lag(x, 5) OVER w, 0) - 1 AS ret5, x / nullif(lag(x, 20) OVER w, 0) - 1 AS ret20, ln(CASE WHEN x > 0 THEN x END) AS l FROM a WINDOW w AS (PARTITION BY factor ORDER BY date))
 SELECT factor, date, round(ret1, 6) AS ret1, round(ret5, 6) AS ret5, round(ret20, 6) AS ret20, round(CASE WHEN count(ret1) OVER w20 >= 20 THEN stddev_samp(ret1) OVER w20 END, 6) AS vol20,
 round((l - CASE WHEN count(l) OVER w60 >= 60 THEN avg(l) OVER w60 END) / nullif(stddev_samp(l) OVER w60, 0), 6) AS level_z60, round(x / CASE WHEN count(x) OVER w20 >= 20 THEN avg(x) OVER w20 END - 1, 6) AS ma20_gap
 FROM b WINDOW w20 AS (PARTITION BY factor ORDER BY date ROWS 19 PRECEDING), w60 AS (PARTITION BY factor ORDER BY date ROWS 59 PRECEDING)""",
)
def market_factor_features(spark, sf_dir):
    rows = _factor(spark, sf_dir, F.avg("o_totalprice"), 1)
    return conditions.market_factor(rows, "x").select("factor", "date", *r6("ret1", "ret5", "ret20", "vol20", "level_z60", "ma20_gap"))


@register(
    "policy_factor_features",
    "WITH "
    + _FACTOR.format(value="floor(max(o_totalprice) / 100000)", late="x")
    + """, b AS (SELECT *, row_number() OVER w AS i, x - lag(x, 1) OVER w AS c1, x - lag(x, 20) OVER w AS c20, x - lag(x, 252) OVER w AS c252 FROM a WINDOW w AS (PARTITION BY factor ORDER BY date))
 SELECT factor, date, round(x, 6) AS level, round(c1, 6) AS change_1d, round(c20, 6) AS change_20d, round(c252, 6) AS change_252d,
 round(ln(1 + i - coalesce(max(CASE WHEN c1 <> 0 THEN i END) OVER (PARTITION BY factor ORDER BY date), 1)), 6) AS days_since_change,
 round((x - CASE WHEN count(x) OVER z >= 252 THEN avg(x) OVER z END) / nullif(stddev_samp(x) OVER z, 0), 6) AS level_z252
 FROM b WINDOW z AS (PARTITION BY factor ORDER BY date ROWS 251 PRECEDING)""",
)
def policy_factor_features(spark, sf_dir):
    rows = _factor(spark, sf_dir, F.floor(F.max("o_totalprice") / 100000).cast("double"), 0)
    got = conditions.policy_factor(rows, "x").withColumnRenamed("x", "level")
    return got.select("factor", "date", *r6("level", "change_1d", "change_20d", "change_252d", "days_since_change", "level_z252"))


def _ratio(n: int) -> str:
    w = f"OVER (PARTITION BY ticker ORDER BY date ROWS {n - 1} PRECEDING)"
    return f"round(greatest(least(CASE WHEN count(f) {w} >= {n} THEN sum(f) {w} END / nullif(CASE WHEN count(v) {w} >= {n} THEN sum(v) {w} END, 0), 5), -5), 6) AS flow_ratio_{n}d"


@register(
    "flow_ratios",
    f"""WITH {DENSE}, net AS (SELECT p_brand AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, sum(CASE l_returnflag WHEN 'A' THEN l_extendedprice WHEN 'R' THEN -l_extendedprice ELSE 0 END) AS flow
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
 late AS (SELECT ticker, date, lag(flow) OVER w AS f, lag(nullif(value, 0)) OVER w AS v FROM r LEFT JOIN net USING (ticker, date) WINDOW w AS (PARTITION BY ticker ORDER BY date))
 SELECT ticker, date, {_ratio(1)}, {_ratio(5)}, {_ratio(20)} FROM late""",
)
def flow_ratios(spark, sf_dir):
    sign = F.when(F.col("l_returnflag") == "A", F.col("l_extendedprice")).when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(0.0)
    ticks = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("ticker")), F.col("l_partkey") == F.col("p_partkey"))
    net = ticks.groupBy("ticker", F.date_trunc("week", "l_shipdate").cast("date").alias("date")).agg(F.sum(sign).alias("flow"))
    rows = with_returns(spark, sf_dir).join(net, ["ticker", "date"], "left")
    return conditions.flow_ratios(rows, "flow", "value").select("ticker", "date", *r6("flow_ratio_1d", "flow_ratio_5d", "flow_ratio_20d"))


@register(
    "trailing_turnover",
    f"""WITH {BARS}, t AS (SELECT ticker, CASE WHEN date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND close > 0 AND volume > 0 THEN close * volume END AS t FROM bars)
 SELECT ticker, count(t) AS observations, round(avg(t), 4) AS mean_turnover, round(median(t), 4) AS median_turnover FROM t GROUP BY ticker""",
)
def trailing_turnover(spark, sf_dir):
    got = conditions.trailing_turnover(weekly(spark, sf_dir), F.to_date(F.lit("1996-01-01")), F.to_date(F.lit("1996-12-31")))
    return got.select("ticker", "observations", F.round("mean_turnover", 4).alias("mean_turnover"), F.round("median_turnover", 4).alias("median_turnover"))


@register(
    "robust_scale",
    f"""WITH {DENSE}, u AS (UNPIVOT (SELECT return_1d, return_4d, volume, CASE WHEN return_1d IS NOT NULL THEN 0.5 END::DOUBLE AS flat FROM r WHERE date < DATE '1997-01-01') ON return_1d, return_4d, volume, flat INTO NAME feature VALUE x),
 m AS (SELECT feature, median(x) AS m FROM u GROUP BY feature),
 s AS (SELECT feature, count(x) AS n, first(m) AS m, 1.4826 * median(abs(x - m)) AS mad, sqrt(avg((x - m) ** 2)) AS rms FROM u JOIN m USING (feature) GROUP BY feature)
 SELECT feature, n, round(CASE WHEN n >= 3 THEN m ELSE 0 END, 6) AS center, round(CASE WHEN n < 3 THEN 1 WHEN mad >= 1e-6 THEN mad WHEN rms >= 1e-6 THEN rms ELSE 1 END, 6) AS scale FROM s""",
)
def robust_scale(spark, sf_dir):
    r = with_returns(spark, sf_dir).where("date < DATE '1997-01-01'").withColumn("flat", F.when(F.col("return_1d").isNotNull(), F.lit(0.5)))
    long = r.unpivot([], ["return_1d", "return_4d", "volume", "flat"], "feature", "x").where("x is not null")
    return conditions.robust_scale(long, "feature", "x").select("feature", "n", *r6("center", "scale"))


@register(
    "transition_labels",
    f"""WITH {DENSE}, d AS (SELECT date, median(return_1d) AS m, avg(CASE WHEN return_1d IS NOT NULL THEN CAST(return_1d > 0 AS INT) END) AS breadth, median(abs(return_1d)) AS price, stddev_samp(return_4d) AS spread FROM r GROUP BY date),
 q AS (SELECT quantile_cont(price, 0.9) AS tp, quantile_cont(spread, 0.9) AS ts, quantile_cont(m, 0.1) AS tm, quantile_cont(breadth, 0.2) AS tb FROM d),
 l AS (SELECT date, price, spread, tp, ts, coalesce(price >= tp, false) AS event_price, coalesce(spread >= ts, false) AS event_spread, coalesce(m <= tm AND breadth <= tb, false) AS broad_selloff FROM d CROSS JOIN q)
 SELECT date, event_price, event_spread, broad_selloff, broad_selloff OR event_price OR event_spread AS systemic_event,
 round(CASE WHEN price IS NOT NULL AND spread IS NOT NULL THEN greatest(price / greatest(tp, 1e-12), spread / greatest(ts, 1e-12), CAST(broad_selloff AS INT)) END, 6) AS systemic_impact FROM l""",
)
def transition_labels(spark, sf_dir):
    r = with_returns(spark, sf_dir)
    up = F.when(F.col("return_1d").isNotNull(), (F.col("return_1d") > 0).cast("int"))
    d = r.groupBy("date").agg(F.median("return_1d").alias("m"), F.avg(up).alias("breadth"), F.median(F.abs("return_1d")).alias("price"), F.stddev_samp("return_4d").alias("spread"))
    fit = d.agg(*[F.percentile(x, p).alias(t) for x, p, t in (("price", 0.9, "tp"), ("spread", 0.9, "ts"), ("m", 0.1, "tm"), ("breadth", 0.2, "tb"))])
    both = d.crossJoin(F.broadcast(fit))  # one row of thresholds
    got = conditions.transition_labels(both, {"price": F.col("tp"), "spread": F.col("ts")}, (F.col("m") <= F.col("tm")) & (F.col("breadth") <= F.col("tb")))
    return got.select("date", "event_price", "event_spread", "broad_selloff", "systemic_event", *r6("systemic_impact"))


@register(
    "disclosure_reactions",
    f"""WITH {DENSE}, p AS (SELECT ticker, date, observed, close, lead(close, 1) OVER w AS c1, lead(open, 1) OVER w AS o1, lead(close, 6) OVER w AS cd, lead(date, 6) OVER w AS has FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date))
 SELECT ticker, date, round(c1 / close - 1, 6) AS reaction, round(CASE WHEN c1 > 0 THEN cd / c1 - 1 END, 6) AS drift, round(abs(o1 / close - 1), 6) AS gap FROM p WHERE observed AND has IS NOT NULL AND close > 0 AND c1 IS NOT NULL""",
)
def disclosure_reactions(spark, sf_dir):
    return conditions.reactions(dense(spark, sf_dir), F.col("observed"), 5).select("ticker", "date", *r6("reaction", "drift", "gap"))


@register(
    "budget_multiplier",
    f"""WITH {DENSE}, k AS (SELECT date, return_4d AS s, row_number() OVER (PARTITION BY date ORDER BY return_4d DESC, ticker) AS i, count(*) OVER (PARTITION BY date) AS n FROM r WHERE return_4d IS NOT NULL),
 w AS (SELECT date, avg(s) AS raw FROM k WHERE n >= 10 AND i <= 5 GROUP BY date),
 z AS (SELECT date, row_number() OVER (ORDER BY date) AS i, (raw - avg(raw) OVER b) / (stddev_pop(raw) OVER b + 1e-12) AS z FROM w WINDOW b AS (ORDER BY date ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING))
 SELECT date, round(CASE WHEN i <= 40 THEN 1.0 ELSE least(1.5, greatest(0.5, 1 + 0.25 * z)) END::DOUBLE, 6) AS multiplier FROM z""",
)
def budget_multiplier(spark, sf_dir):
    return conditions.budget(with_returns(spark, sf_dir), "return_4d", 5, 10, 40, 0.25, 0.5, 1.5).select("date", *r6("multiplier"))


@register(
    "last_values",
    """SELECT o_custkey, max(o_totalprice) FILTER (WHERE false) AS nothing, arg_max(o_totalprice, (o_orderdate, o_orderkey)) FILTER (WHERE o_totalprice > 100000) AS price, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderpriority <> '5-LOW') AS priority
 FROM orders GROUP BY o_custkey""",
)
def last_values(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("price"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"), F.lit(None).cast("double").alias("nothing"))
    return conditions.last_values(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["price", "priority", "nothing"])


@register(
    "usable_sessions",
    f"WITH {DENSE}, f AS (SELECT date, lead(close, 1) OVER w / nullif(close, 0) - 1 AS t1, lead(close, 5) OVER w / nullif(close, 0) - 1 AS t5 FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date)) SELECT date, row_number() OVER (ORDER BY date) > 80 AND count(t1) >= 4 AND count(t5) >= 4 AS usable FROM f GROUP BY date",
)
def usable_sessions(spark, sf_dir):
    p = dense(spark, sf_dir).withColumns({f"t{k}": F.lead("close", k).over(by()) / F.nullif("close", F.lit(0.0)) - 1 for k in (1, 5)})
    return conditions.usable_sessions(p, ["t1", "t5"], 80, 4)
