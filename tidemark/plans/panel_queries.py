"""Queries over the brand x week panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..operators import backtest, edges, metrics, panel, relational
from ..operators.frames import last_rows, prior_rows
from ..sources.readers import parquet_table as table

BARS = """bars AS (
 SELECT ticker, date, first(p ORDER BY l_shipdate, l_orderkey, l_linenumber) AS open, max(p) AS high, min(p) AS low,
  last(p ORDER BY l_shipdate, l_orderkey, l_linenumber) AS close, sum(l_quantity) AS volume
 FROM (SELECT p_brand AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_extendedprice / l_quantity AS p, l_quantity, l_shipdate, l_orderkey, l_linenumber
       FROM lineitem JOIN part ON l_partkey = p_partkey)
 GROUP BY ticker, date)"""
DENSE = (
    BARS
    + """, marked AS (SELECT *, coalesce(least(open, high, low, close) > 0 AND NOT (open = high AND high = low AND low = close AND volume <= 0), false) AS observed FROM bars),
 dense AS (
 SELECT t.ticker, d.date, CASE WHEN m.observed THEN m.open END AS open, CASE WHEN m.observed THEN m.high END AS high, CASE WHEN m.observed THEN m.low END AS low,
  CASE WHEN m.observed THEN m.close END AS close, coalesce(m.volume, 0) AS volume, coalesce(m.observed, false) AS observed
 FROM (SELECT DISTINCT ticker FROM bars) t CROSS JOIN (SELECT DISTINCT date FROM bars) d LEFT JOIN marked m ON m.ticker = t.ticker AND m.date = d.date),
 panel AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS execution_close FROM dense),
 r AS (SELECT *, close / nullif(lag(close, 1) OVER w, 0) - 1 AS return_1d, close / nullif(lag(close, 4) OVER w, 0) - 1 AS return_4d, close * volume AS value FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date))"""
)


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    ticks = ticks.withColumn("o", panel.order_key(F.col("l_shipdate").cast("date"), F.col("l_orderkey"), F.col("l_linenumber")))
    return panel.bars(ticks, "p_brand", F.date_trunc("week", "l_shipdate").cast("date"), F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"), ["o"])


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.densify(weekly(spark, sf_dir))


def with_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense(spark, sf_dir).withColumns({"return_1d": panel.change("close", 1), "return_4d": panel.change("close", 4), "value": F.col("close") * F.col("volume")})


def r6(*names: str) -> list:
    """Columns rounded for comparison."""
    return [F.round(n, 6).alias(n) for n in names]


def half6(*names: str) -> list:
    """Columns rounded as SQL's engine rounds: the product with 1e6, in floating point, to a whole number. Where many values end in a 5 at the
    seventh place, the nearest decimal and this product fall on different sides."""
    return [(F.round(F.col(n) * 1e6, 0) / 1e6).alias(n) for n in names]


def s6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


@register("daily_bars", f"WITH {BARS} SELECT ticker, date, {', '.join(f'round({c}, 9) AS {c}' for c in ('open', 'high', 'low', 'close', 'volume'))} FROM bars")
def daily_bars(spark, sf_dir):
    return weekly(spark, sf_dir).select("ticker", "date", *[F.round(c, 9).alias(c) for c in ("open", "high", "low", "close", "volume")])


@register("daily_panel_dense", f"WITH {DENSE} SELECT ticker, date, observed, {s6('close', 'volume', 'execution_close')} FROM panel")
def daily_panel_dense(spark, sf_dir):
    return dense(spark, sf_dir).select("ticker", "date", "observed", *r6("close", "volume", "execution_close"))


def _lagged(k: int) -> str:
    return f"round(close / nullif(lag(close, {k}) OVER w, 0) - 1, 6) AS return_{k}d"


@register("returns_k", f"WITH {DENSE} SELECT ticker, date, {', '.join(map(_lagged, panel.RETURNS))} FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date)")
def returns_k(spark, sf_dir):
    return dense(spark, sf_dir).select("ticker", "date", *[F.round(panel.change("close", k), 6).alias(f"return_{k}d") for k in panel.RETURNS])


def _frame(n: int) -> str:
    return f"OVER (PARTITION BY ticker ORDER BY date ROWS {n - 1} PRECEDING)"


def _full(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {_frame(n)} >= {n} THEN {agg} {_frame(n)} END"


@register("ma_gap", f"WITH {DENSE} SELECT ticker, date, " + ", ".join(f"round(close / nullif({_full('avg(close)', 'close', n)}, 0) - 1, 6) AS ma{n}_gap" for n in panel.AVERAGES) + " FROM r")
def ma_gap(spark, sf_dir):
    return panel.price_features(dense(spark, sf_dir)).select("ticker", "date", *r6(*[f"ma{n}_gap" for n in panel.AVERAGES]))


@register("volatility", f"WITH {DENSE} SELECT ticker, date, " + ", ".join(f"round({_full('stddev_samp(return_1d)', 'return_1d', n)}, 6) AS volatility_{n}d" for n in panel.VOLATILITIES) + " FROM r")
def volatility(spark, sf_dir):
    return panel.price_features(dense(spark, sf_dir)).select("ticker", "date", *r6(*[f"volatility_{n}d" for n in panel.VOLATILITIES]))


_DOWN = "CASE WHEN return_1d < 0 THEN return_1d ELSE 0 END"


@register("downside_volatility", f"WITH {DENSE} SELECT ticker, date, round(CASE WHEN count(*) {_frame(20)} >= 20 THEN stddev_samp({_DOWN}) {_frame(20)} END, 6) AS downside_volatility_20d FROM r")
def downside_volatility(spark, sf_dir):
    return panel.price_features(dense(spark, sf_dir)).select("ticker", "date", *r6("downside_volatility_20d"))


def _z(x: str, n: int) -> str:
    return f"round(CASE WHEN count({x}) {_frame(n)} >= {n} THEN ({x} - avg({x}) {_frame(n)}) / nullif(stddev_samp({x}) {_frame(n)}, 0) END, 6)"


@register(
    "rolling_zscores",
    f"""WITH {DENSE}, q AS (SELECT *, (high - low) / nullif(close, 0) AS range_pct, ln(1 + volume) AS volume_log, ln(1 + value) AS value_log FROM r)
 SELECT ticker, date, {_z('volume_log', 20)} AS volume_z20, {_z('volume_log', 60)} AS volume_z60, {_z('value_log', 20)} AS value_z20, {_z('value_log', 60)} AS value_z60, {_z('range_pct', 20)} AS range_z20 FROM q""",
)
def rolling_zscores(spark, sf_dir):
    return panel.price_features(dense(spark, sf_dir)).select("ticker", "date", *r6("volume_z20", "volume_z60", "value_z20", "value_z60", "range_z20"))


@register(
    "drawdown_breakout_range",
    f"""WITH {DENSE} SELECT ticker, date, round(close / nullif({_full('max(close)', 'close', 20)}, 0) - 1, 6) AS drawdown_20d, round(close / nullif({_full('max(close)', 'close', 120)}, 0) - 1, 6) AS drawdown_120d,
 round(close / nullif({_full('min(close)', 'close', 20)}, 0) - 1, 6) AS breakout_20d, round(close / nullif({_full('min(close)', 'close', 120)}, 0) - 1, 6) AS breakout_120d,
 round((close - {_full('min(close)', 'close', 120)}) / nullif({_full('max(close)', 'close', 120)} - {_full('min(close)', 'close', 120)}, 0), 6) AS range_position_120d FROM r""",
)
def drawdown_breakout_range(spark, sf_dir):
    return panel.price_features(dense(spark, sf_dir)).select("ticker", "date", *r6("drawdown_20d", "drawdown_120d", "breakout_20d", "breakout_120d", "range_position_120d"))


@register(
    "liquidity_features",
    f"WITH {DENSE} SELECT ticker, date, round(ln(1 + {_full('avg(value)', 'value', 20)}), 6) AS value_ma20_log, round(1e6 * ({_full('avg(abs(return_1d) / nullif(value, 0))', '(abs(return_1d) / nullif(value, 0))', 20)}), 6) AS amihud_20d FROM r",
)
def liquidity_features(spark, sf_dir):
    p = panel.price_features(dense(spark, sf_dir)).withColumn("amihud_20d", F.col("amihud_20d") * 1e6)
    return p.select("ticker", "date", *r6("value_ma20_log", "amihud_20d"))


@register(
    "gap_and_intraday",
    f"WITH {DENSE} SELECT ticker, date, round(open / nullif(lag(close, 1) OVER (PARTITION BY ticker ORDER BY date), 0) - 1, 6) AS gap_open, round(close / nullif(open, 0) - 1, 6) AS intraday_return, round((high - low) / nullif(close, 0), 6) AS range_pct FROM panel",
)
def gap_and_intraday(spark, sf_dir):
    return panel.price_features(dense(spark, sf_dir)).select("ticker", "date", *r6("gap_open", "intraday_return", "range_pct"))


@register(
    "cross_section_rank",
    f"""WITH {DENSE}, s AS (SELECT * FROM r WHERE return_4d IS NOT NULL) SELECT ticker, date,
 round((rank() OVER (PARTITION BY date ORDER BY return_4d) + (count(*) OVER (PARTITION BY date, return_4d) - 1) / 2.0) / count(*) OVER (PARTITION BY date) - 0.5, 6) AS cs_rank,
 round(CASE WHEN count(*) OVER (PARTITION BY date) >= 3 AND stddev_pop(return_4d) OVER (PARTITION BY date) > 0 THEN (return_4d - avg(return_4d) OVER (PARTITION BY date)) / stddev_pop(return_4d) OVER (PARTITION BY date) END, 6) AS cs_z FROM s""",
)
def cross_section_rank(spark, sf_dir):
    return panel.cross_section(with_returns(spark, sf_dir), "return_4d").select("ticker", "date", *r6("cs_rank", "cs_z"))


_MARKET = DENSE + ", m AS (SELECT *, avg(return_1d) OVER (PARTITION BY date) AS market FROM r)"


@register("relative_return", f"WITH {_MARKET} SELECT ticker, date, {s6('market')}, round(return_1d - market, 6) AS relative FROM m")
def relative_return(spark, sf_dir):
    return panel.with_market(with_returns(spark, sf_dir)).select("ticker", "date", *r6("market", "relative"))


_PAIR = "CASE WHEN market IS NOT NULL THEN return_1d END"


@register(
    "market_beta",
    f"""WITH {_MARKET} SELECT ticker, date, round(CASE WHEN count({_PAIR}) {_frame(60)} >= 60 THEN covar_samp({_PAIR}, market) {_frame(60)} / nullif(var_samp(market) {_frame(60)}, 0) END, 6) AS beta,
 round(CASE WHEN count({_PAIR}) {_frame(60)} >= 60 THEN corr({_PAIR}, market) {_frame(60)} END, 6) AS corr FROM m""",
)
def market_beta(spark, sf_dir):
    return panel.beta(panel.with_market(with_returns(spark, sf_dir))).select("ticker", "date", *r6("beta", "corr"))


_PATH = "OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)"
_TARGET = (
    DENSE
    + f""", t0 AS (SELECT *, ln(close / lag(close, 1) OVER w) AS step, lead(open, 1) OVER w AS entry, lead(close, 4) OVER w AS last_close FROM r WINDOW w AS (PARTITION BY ticker ORDER BY date)),
 t AS (SELECT *, CASE WHEN count(close) {_PATH} = 4 AND entry > 0 THEN last_close / entry - 1 END AS target_return, CASE WHEN count(close) {_PATH} = 4 AND entry > 0 THEN max(close) {_PATH} / entry - 1 END AS target_best,
 CASE WHEN count(close) {_PATH} = 4 AND entry > 0 THEN min(close) {_PATH} / entry - 1 END AS target_worst, CASE WHEN count(close) {_PATH} = 4 AND entry > 0 AND count(step) {_PATH} = 4 THEN stddev_pop(step) {_PATH} END AS target_volatility FROM t0)"""
)


@register("forward_targets", f"WITH {_TARGET} SELECT ticker, date, {s6('target_return', 'target_best', 'target_worst', 'target_volatility')} FROM t")
def forward_targets(spark, sf_dir):
    return panel.forward_targets(with_returns(spark, sf_dir), 4).select("ticker", "date", *r6("target_return", "target_best", "target_worst", "target_volatility"))


def scored(spark, sf_dir) -> DataFrame:
    return panel.forward_targets(with_returns(spark, sf_dir), 4)


_ROBUST = ("mean", "mean_abs", "rms", "std", "median", "q75", "mad", "breadth", "coherence", "concentration")


@register(
    "robust_cross_section",
    f"""WITH {DENSE}, s AS (SELECT *, quantile_cont(return_1d, 0.5) OVER (PARTITION BY date) AS mid FROM r WHERE return_1d IS NOT NULL),
 g AS (SELECT date, count(*) AS n, avg(return_1d) AS mean, avg(abs(return_1d)) AS mean_abs, sqrt(avg(return_1d * return_1d)) AS rms, stddev_pop(return_1d) AS std, max(mid) AS median, quantile_cont(return_1d, 0.75) AS q75,
  quantile_cont(abs(return_1d - mid), 0.5) * 1.4826 AS mad, avg(CASE WHEN return_1d > 0 THEN 1.0 ELSE 0.0 END) AS breadth, abs(sum(return_1d)) / nullif(sum(abs(return_1d)), 0) AS coherence,
  sum(abs(return_1d) ** 2) / nullif(sum(abs(return_1d)) ** 2, 0) AS concentration FROM s GROUP BY date)
 SELECT date, n, {s6(*_ROBUST)} FROM g WHERE n >= 4""",
)
def robust_cross_section(spark, sf_dir):
    return panel.robust_cross_section(with_returns(spark, sf_dir), "return_1d").select("date", "n", *r6(*_ROBUST))


@register(
    "daily_ic",
    f"""WITH {_TARGET}, s AS (SELECT * FROM t WHERE return_4d IS NOT NULL AND target_return IS NOT NULL), k AS (SELECT *, rank() OVER (PARTITION BY date ORDER BY return_4d) + (count(*) OVER (PARTITION BY date, return_4d) - 1) / 2.0 AS rp,
 rank() OVER (PARTITION BY date ORDER BY target_return) + (count(*) OVER (PARTITION BY date, target_return) - 1) / 2.0 AS rt FROM s)
 SELECT date, count(*) AS n, round(CASE WHEN count(*) >= 3 AND stddev_pop(return_4d) > 1e-12 AND stddev_pop(target_return) > 1e-12 THEN corr(return_4d, target_return) END, 6) AS ic,
 round(CASE WHEN count(*) >= 3 AND stddev_pop(return_4d) > 1e-12 AND stddev_pop(target_return) > 1e-12 THEN corr(rp, rt) END, 6) AS rank_ic FROM k GROUP BY date""",
)
def daily_ic(spark, sf_dir):
    return metrics.daily_ic(scored(spark, sf_dir), "return_4d", "target_return").select("date", "n", *r6("ic", "rank_ic"))


@register(
    "newey_west_ic",
    f"""WITH {_TARGET}, i AS (SELECT date, corr(return_4d, target_return) AS ic FROM t WHERE return_4d IS NOT NULL AND target_return IS NOT NULL GROUP BY date HAVING count(*) >= 3 AND stddev_pop(return_4d) > 1e-12 AND stddev_pop(target_return) > 1e-12),
 c AS (SELECT date, ic, ic - avg(ic) OVER () AS c FROM i), l AS (SELECT *, c * lag(c, 1) OVER w AS p1, c * lag(c, 2) OVER w AS p2, c * lag(c, 3) OVER w AS p3 FROM c WINDOW w AS (ORDER BY date)),
 v AS (SELECT count(*) AS n, avg(ic) AS mean, sum(c * c) / count(*) + 2 * 0.75 * coalesce(sum(p1), 0) / count(*) + 2 * 0.5 * coalesce(sum(p2), 0) / count(*) + 2 * 0.25 * coalesce(sum(p3), 0) / count(*) AS var FROM l)
 SELECT 'ic' AS series, n, round(mean, 6) AS mean, round(mean / sqrt(CASE WHEN var > 0 THEN var END / n), 4) AS t_value FROM v""",
)
def newey_west_ic(spark, sf_dir):
    ic = metrics.daily_ic(scored(spark, sf_dir), "return_4d", "target_return").withColumn("series", F.lit("ic"))
    return metrics.newey_west(ic, "ic", "date", 3).select("series", "n", F.round("mean", 6).alias("mean"), F.round("t_value", 4).alias("t_value"))


@register(
    "decile_spread",
    f"""WITH {_TARGET}, s AS (SELECT *, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY return_4d DESC, ticker) AS up, row_number() OVER (PARTITION BY date ORDER BY return_4d, ticker) AS dn FROM t WHERE return_4d IS NOT NULL AND target_return IS NOT NULL),
 g AS (SELECT date, avg(CASE WHEN up <= greatest(1, floor(n * 0.1)) THEN target_return END) AS top, avg(CASE WHEN dn <= greatest(1, floor(n * 0.1)) THEN target_return END) AS bottom FROM s WHERE n >= 20 GROUP BY date)
 SELECT date, {s6('top', 'bottom')}, round(top - bottom, 6) AS spread FROM g""",
)
def decile_spread(spark, sf_dir):
    return metrics.decile_spread(scored(spark, sf_dir), "return_4d", "target_return").select("date", *r6("top", "bottom", "spread"))


@register("topk_momentum", f"WITH {DENSE} SELECT ticker, date, CAST(row_number() OVER (PARTITION BY date ORDER BY return_4d DESC, ticker) AS BIGINT) AS pick, {s6('return_4d')} FROM r WHERE return_4d IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date ORDER BY return_4d DESC, ticker) <= 5")
def topk_momentum(spark, sf_dir):
    return backtest.top_k(with_returns(spark, sf_dir), "return_4d", 5).select("ticker", "date", F.col("pick").cast("long").alias("pick"), *r6("return_4d"))


@register(
    "topk_liquid_then_score",
    f"""WITH {DENSE}, l AS (SELECT * FROM r WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date ORDER BY value DESC, ticker DESC) <= 12)
 SELECT ticker, date, CAST(row_number() OVER (PARTITION BY date ORDER BY return_4d DESC, ticker) AS BIGINT) AS pick FROM l WHERE return_4d IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date ORDER BY return_4d DESC, ticker) <= 4""",
)
def topk_liquid_then_score(spark, sf_dir):
    return backtest.liquid_then_best(with_returns(spark, sf_dir), "value", 12, "return_4d", 4).select("ticker", "date", F.col("pick").cast("long").alias("pick"))


_STRIDED = _TARGET + ", d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM t)), s AS (SELECT t.* FROM t JOIN d ON t.date = d.date WHERE d.i % 4 = 0)"
_BACKTEST = (
    _STRIDED
    + """, k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY return_4d DESC, ticker) AS i, count(*) OVER (PARTITION BY date) AS n FROM s WHERE return_4d IS NOT NULL AND target_return IS NOT NULL),
 b AS (SELECT date, string_agg(CASE WHEN i <= 5 THEN ticker END, ',' ORDER BY ticker) AS selected, avg(CASE WHEN i <= 5 THEN target_return END) - 0.001 AS period_return, avg(target_return) - 0.001 AS benchmark_return FROM k WHERE n >= 5 GROUP BY date)"""
)


@register("rank_backtest", f"WITH {_BACKTEST} SELECT date, selected, {s6('period_return', 'benchmark_return')} FROM b")
def rank_backtest(spark, sf_dir):
    return backtest.rank_backtest(scored(spark, sf_dir), "return_4d", "target_return", 5, 4, 0.001).select("date", "selected", *r6("period_return", "benchmark_return"))


@register(
    "performance_metrics",
    f"""WITH {_BACKTEST}, u AS (SELECT 'book' AS strategy, date, period_return AS r FROM b UNION ALL SELECT 'benchmark', date, benchmark_return FROM b), e AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING)) AS e, row_number() OVER (PARTITION BY strategy ORDER BY r, date) AS i, count(*) OVER (PARTITION BY strategy) AS n FROM u),
 f AS (SELECT *, max(e) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM e)
 SELECT strategy, count(*) AS periods, round(sum(ln(1 + r)), 6) AS log_return, round(exp(sum(ln(1 + r))) ** (13.0 / count(*)) - 1, 6) AS cagr, round(min(e / peak - 1), 6) AS max_drawdown,
 round(avg(CASE WHEN i <= greatest(1, floor(n * 0.05)) THEN r END), 6) AS cvar_5, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(13.0), 6) AS sharpe FROM f GROUP BY strategy""",
)
def performance_metrics(spark, sf_dir):
    b = backtest.rank_backtest(scored(spark, sf_dir), "return_4d", "target_return", 5, 4, 0.001)
    u = b.select(F.explode(F.array(F.struct(F.lit("book").alias("strategy"), F.col("period_return").alias("r")), F.struct(F.lit("benchmark").alias("strategy"), F.col("benchmark_return").alias("r")))).alias("x"), "date").select("x.*", "date")
    return metrics.performance(u, "r", "date", 13.0).withColumn("log_return", F.log1p("total_return")).select("strategy", "periods", *r6("log_return", "cagr", "max_drawdown", "cvar_5", "hit_rate", "sharpe"))


@register(
    "turnover",
    f"""WITH {DENSE}, p AS (SELECT ticker, date FROM r WHERE return_4d IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date ORDER BY return_4d DESC, ticker) <= 5), h AS (SELECT date, list(ticker) AS held FROM p GROUP BY date),
 l AS (SELECT date, held, lag(held) OVER (ORDER BY date) AS before FROM h) SELECT date, round(coalesce(1 - len(list_intersect(held, before)) / 5.0, 1.0), 6) AS turnover FROM l""",
)
def turnover(spark, sf_dir):
    return backtest.turnover(backtest.top_k(with_returns(spark, sf_dir), "return_4d", 5), 5).select("date", *r6("turnover"))


@register(
    "stop_take_exit",
    f"""WITH {DENSE}, n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM r), e AS (SELECT a.ticker, a.date, a.i, b.open AS entry FROM n a JOIN n b ON a.ticker = b.ticker AND b.i = a.i + 1 WHERE b.open > 0),
 p AS (SELECT e.ticker, e.date, e.entry, n.i - e.i AS d, n.close / e.entry - 1 AS g FROM e JOIN n ON n.ticker = e.ticker AND n.i BETWEEN e.i + 1 AND e.i + 6),
 w AS (SELECT ticker, date FROM p GROUP BY ticker, date HAVING count(g) = 6), x AS (SELECT p.ticker, p.date, coalesce(min(CASE WHEN g >= 0.05 OR g <= -0.03 THEN d END), 6) AS exit_day FROM p JOIN w ON p.ticker = w.ticker AND p.date = w.date GROUP BY p.ticker, p.date)
 SELECT x.ticker, x.date, x.exit_day, round(p.g, 6) AS exit_return FROM x JOIN p ON p.ticker = x.ticker AND p.date = x.date AND p.d = x.exit_day""",
)
def stop_take_exit(spark, sf_dir):
    return backtest.stop_or_take(dense(spark, sf_dir), 0.03, 0.05, 6).select("ticker", "date", "exit_day", *r6("exit_return"))


@register(
    "rank_exit",
    f"""WITH {DENSE}, n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM r), k AS (SELECT ticker, date, row_number() OVER (PARTITION BY date ORDER BY return_4d DESC, ticker) AS rk FROM n WHERE return_4d IS NOT NULL),
 q AS (SELECT n.*, (SELECT max(date) FROM k WHERE k.date <= n.date) AS sig FROM n), e AS (SELECT a.ticker, a.date, a.i, b.open AS entry FROM q a JOIN q b ON b.ticker = a.ticker AND b.i = a.i + 1 JOIN k ON k.ticker = a.ticker AND k.date = a.date WHERE k.rk <= 5 AND b.open > 0),
 f AS (SELECT e.* FROM e WHERE EXISTS (SELECT 1 FROM q WHERE q.ticker = e.ticker AND q.i = e.i + 8)),
 x AS (SELECT f.ticker, f.date, f.i, f.entry, coalesce(min(CASE WHEN q.sig IS NOT NULL AND NOT EXISTS (SELECT 1 FROM k WHERE k.ticker = q.ticker AND k.date = q.sig AND k.rk <= 10) THEN q.i - f.i + 1 END), 8) AS exit_day FROM f JOIN q ON q.ticker = f.ticker AND q.i BETWEEN f.i + 1 AND f.i + 7 GROUP BY ALL)
 SELECT x.ticker, x.date, x.exit_day, round(q.execution_close / x.entry - 1, 6) AS exit_return FROM x JOIN q ON q.ticker = x.ticker AND q.i = x.i + x.exit_day""",
)
def rank_exit(spark, sf_dir):
    return backtest.rank_exit(with_returns(spark, sf_dir), "return_4d", 5, 10, 8).select("ticker", "date", "exit_day", *r6("exit_return"))


@register("ladder_exit", f"WITH {DENSE}, x AS (SELECT ticker, date, lead(open, 1) OVER w AS entry, lead(close, 2) OVER w AS a, lead(close, 4) OVER w AS b, lead(close, 6) OVER w AS c FROM r WINDOW w AS (PARTITION BY ticker ORDER BY date)), y AS (SELECT ticker, date, CASE WHEN entry > 0 THEN ((a / entry - 1) + (b / entry - 1) + (c / entry - 1)) / 3 END AS ladder_return FROM x) SELECT ticker, date, {s6('ladder_return')} FROM y WHERE ladder_return IS NOT NULL")
def ladder_exit(spark, sf_dir):
    return backtest.ladder_exit(dense(spark, sf_dir), [2, 4, 6]).select("ticker", "date", *r6("ladder_return"))


@register(
    "scale_in",
    f"""WITH {DENSE}, n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM panel), e AS (SELECT a.ticker, a.date, a.i, b.open AS entry, coalesce(z.execution_close, -1.0) AS last FROM n a JOIN n b ON b.ticker = a.ticker AND b.i = a.i + 1 JOIN n z ON z.ticker = a.ticker AND z.i = a.i + 6 WHERE b.open > 0),
 x AS (SELECT e.ticker, e.date, e.entry, e.last, e.i, coalesce(min(CASE WHEN coalesce(n.execution_close, -1.0) <= e.entry * (1 - 0.02) THEN n.i - e.i END), 0) AS add_day FROM e JOIN n ON n.ticker = e.ticker AND n.i BETWEEN e.i + 1 AND e.i + 3 GROUP BY ALL)
 SELECT x.ticker, x.date, add_day, round(last / entry - 1 + CASE WHEN add_day > 0 THEN last / coalesce(n.execution_close, -1.0) - 1 ELSE 0 END, 6) AS leg_return, CASE WHEN add_day > 0 THEN 2 ELSE 1 END AS capital FROM x LEFT JOIN n ON n.ticker = x.ticker AND n.i = x.i + x.add_day""",
)
def scale_in(spark, sf_dir):
    return backtest.scale_in(dense(spark, sf_dir), 0.02, 3, 6).select("ticker", "date", "add_day", *r6("leg_return"), "capital")


_CORR = (
    DENSE
    + """, d AS (SELECT DISTINCT date FROM r ORDER BY date DESC LIMIT 61), h AS (SELECT ticker, date, coalesce(return_1d, 0) AS x FROM r WHERE date IN (SELECT date FROM d)), c AS (SELECT ticker, date, x - avg(x) OVER (PARTITION BY ticker) AS c FROM h),
 n AS (SELECT ticker, sqrt(sum(c * c)) AS norm FROM c GROUP BY ticker), p AS (SELECT a.ticker AS src, b.ticker AS dst, sum(a.c * b.c) AS dot FROM c a JOIN c b ON a.date = b.date AND a.ticker <> b.ticker GROUP BY ALL),
 e0 AS (SELECT (SELECT max(date) FROM r) AS step, src, dst, round_even(dot / (n.norm * m.norm), 4) AS weight FROM p JOIN n ON n.ticker = src JOIN n m ON m.ticker = dst WHERE n.norm > 1e-12 AND m.norm > 1e-12),
 e AS (SELECT * FROM e0 WHERE abs(weight) >= 0.1 QUALIFY row_number() OVER (PARTITION BY step, src ORDER BY abs(weight) DESC, dst DESC) <= 6)"""
)


@register("corr_edges", f"WITH {_CORR} SELECT step, src, dst, weight FROM e")
def corr_edges(spark, sf_dir):
    return edges.correlation_edges(with_returns(spark, sf_dir), "return_1d", 61, 0.1, 6)


@register(
    "neighbour_mean",
    f"WITH {_CORR}, v AS (SELECT ticker, arg_max(return_4d, date) AS x FROM r WHERE return_4d IS NOT NULL GROUP BY ticker) SELECT step, dst, round(sum(weight * x) / greatest(sum(abs(weight)), 1.0), 6) AS neighbour_mean FROM e JOIN v ON v.ticker = e.src GROUP BY step, dst",
)
def neighbour_mean(spark, sf_dir):
    p = with_returns(spark, sf_dir)
    e = edges.correlation_edges(p, "return_1d", 61, 0.1, 6)
    return edges.neighbour_mean(e, p.where("return_4d is not null").groupBy("ticker").agg(F.max_by("return_4d", "date").alias("x")), "x").select("step", "dst", *r6("neighbour_mean"))


@register(
    "train_scaler",
    f"""WITH {DENSE}, f AS (SELECT avg(return_1d) AS m, CASE WHEN stddev_pop(return_1d) < 1e-6 THEN 1.0 ELSE stddev_pop(return_1d) END AS s FROM r WHERE date <= DATE '1996-01-01')
 SELECT ticker, date, round(coalesce((return_1d - m) / s, 0.0), 6) AS return_1d FROM r, f""",
)
def train_scaler(spark, sf_dir):
    import datetime

    return panel.scaled(with_returns(spark, sf_dir).select("ticker", "date", "return_1d"), ["return_1d"], datetime.date(1996, 1, 1)).select("ticker", "date", *r6("return_1d"))


@register(
    "history_filter",
    f"WITH {BARS} SELECT ticker, count(*) FILTER (WHERE date <= DATE '1996-01-01') AS train_rows FROM bars GROUP BY ticker HAVING count(*) FILTER (WHERE date <= DATE '1996-01-01') >= 50",
)
def history_filter(spark, sf_dir):
    return weekly(spark, sf_dir).groupBy("ticker").agg(F.count_if(F.col("date") <= F.lit("1996-01-01").cast("date")).alias("train_rows")).where("train_rows >= 50")


@register(
    "bar_audit",
    f"WITH {DENSE} SELECT ticker, count(*) AS sessions, count(*) FILTER (WHERE NOT observed) AS unobserved, count(*) FILTER (WHERE high < greatest(open, close) OR low > least(open, close)) AS impossible, count(*) FILTER (WHERE abs(return_1d) > 0.35) AS jumps FROM r GROUP BY ticker",
)
def bar_audit(spark, sf_dir):
    p = with_returns(spark, sf_dir)
    bad = (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))
    return p.groupBy("ticker").agg(F.count("*").alias("sessions"), F.count_if(~F.col("observed")).alias("unobserved"), F.count_if(bad).alias("impossible"), F.count_if(F.abs("return_1d") > 0.35).alias("jumps"))


@register(
    "causal_return_tail",
    f"""WITH {DENSE}, v AS (SELECT ticker, date, abs(return_1d) AS x FROM r WHERE return_1d IS NOT NULL), h AS (SELECT ticker, date, x, list_sort(list(x) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)) AS h FROM v)
 SELECT ticker, date, round(CASE WHEN len(h) >= 20 THEN h[CAST(ceil((len(h) - 1) * 0.9) AS INT) + 1] END, 6) AS tail FROM h""",
)
def causal_return_tail(spark, sf_dir):
    from ..operators.events import causal_tail

    v = with_returns(spark, sf_dir).select("ticker", "date", F.abs("return_1d").alias("x"))
    return causal_tail(v, "ticker", "date", "x", 60, 0.9, 20).select("ticker", "date", *r6("tail"))


@register(
    "volatility_regime_z",
    f"""WITH {_MARKET}, d AS (SELECT date, max(market) AS market FROM m GROUP BY date), v AS (SELECT date, CASE WHEN count(market) OVER w >= 20 THEN stddev_pop(market) OVER w END AS vol FROM d WINDOW w AS (ORDER BY date ROWS 19 PRECEDING))
 SELECT date, round(vol, 6) AS vol, round(CASE WHEN count(vol) OVER p >= 60 THEN (vol - avg(vol) OVER p) / nullif(stddev_pop(vol) OVER p, 0) END, 6) AS regime_z FROM v WINDOW p AS (ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)""",
)
def volatility_regime_z(spark, sf_dir):
    d = panel.with_market(with_returns(spark, sf_dir)).groupBy("date").agg(F.max("market").alias("market")).withColumn("ticker", F.lit("market"))
    f, p = last_rows(20), prior_rows(60)
    v = d.withColumn("vol", F.when(F.count("market").over(f) >= 20, F.stddev_pop("market").over(f)))
    z = F.when(F.count("vol").over(p) >= 60, panel.ratio(F.col("vol") - F.avg("vol").over(p), F.stddev_pop("vol").over(p)))
    return v.withColumn("regime_z", z).select("date", *r6("vol", "regime_z"))


@register(
    "return_index",
    f"WITH {DENSE}, a AS (SELECT ticker, date, close / nullif(lag(close, 1) OVER (PARTITION BY ticker ORDER BY date), 0) AS q FROM panel) SELECT ticker, date, round(exp(coalesce(sum(CASE WHEN q BETWEEN 0.65 AND 1.35 THEN ln(q) END) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING), 0)), 6) AS proxy_index FROM a",
)
def return_index(spark, sf_dir):
    q = dense(spark, sf_dir).withColumn("q", panel.change("close", 1) + 1)
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    x = F.exp(F.coalesce(F.sum(F.when(F.col("q").between(0.65, 1.35), F.log("q"))).over(w), F.lit(0.0)))
    return q.withColumn("proxy_index", x).select("ticker", "date", *r6("proxy_index"))


@register(
    "quarantine_reasons",
    "SELECT CASE WHEN l_quantity <= 0 THEN 'no_quantity' WHEN l_extendedprice / l_quantity > 1900 THEN 'price_above_range' WHEN l_discount > 0.09 THEN 'discount_above_range' ELSE 'accepted' END AS reason, count(*) AS n FROM lineitem GROUP BY 1",
)
def quarantine_reasons(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rules = [("no_quantity", F.col("l_quantity") <= 0), ("price_above_range", F.col("l_extendedprice") / F.col("l_quantity") > 1900), ("discount_above_range", F.col("l_discount") > 0.09)]
    return relational.with_reason(li, rules).groupBy("reason").agg(F.count("*").alias("n"))
