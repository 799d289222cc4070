"""Queries of paths, peaks and the evaluation of signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..operators import metrics, paths
from ..operators.frames import by
from ..operators.ranges import running_sums
from ..sources.readers import parquet_table as table
from ..sources.shared import written
from .panel_queries import DENSE, dense, r6, s6, with_returns

_H = (1, 2, 4)
_SHOCK = f"""{DENSE}, o AS (SELECT ticker, date, open / lag(execution_close) OVER w - 1 AS gap, {", ".join(f"lead(close, {h - 1}) OVER w / open - 1 AS h{h}" for h in _H)} FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date)),
 g AS (SELECT date, ticker, gap FROM o WHERE gap IS NOT NULL), d0 AS (SELECT date, median(gap) AS open_median, avg(gap) AS mean, avg(sign(gap)) AS sg, median(abs(gap)) AS ab FROM g GROUP BY date HAVING count(*) >= 8),
 d AS (SELECT date, open_median, sign(CASE WHEN abs(open_median) > 1e-12 THEN open_median ELSE mean END) AS direction, sign(CASE WHEN abs(open_median) > 1e-12 THEN open_median ELSE mean END) * sg AS open_breadth, ab FROM d0),
 e AS (SELECT *, sqrt(open_median ** 2 + (ab * greatest(open_breadth, 0)) ** 2) AS open_energy FROM d WHERE direction <> 0),
 l AS (UNPIVOT (SELECT date, ticker, {", ".join(f"h{h}" for h in _H)} FROM o) ON {", ".join(f"h{h}" for h in _H)} INTO NAME h VALUE from_open),
 j0 AS (SELECT l.date, l.ticker, CAST(substr(h, 2) AS INT) AS horizon, from_open, gap, direction, direction * from_open AS along FROM l JOIN g USING (date, ticker) JOIN e USING (date)), j AS (SELECT * FROM j0 QUALIFY count(*) OVER (PARTITION BY date, horizon) >= 8),
 m AS (SELECT date, horizon, median(from_open) AS remaining, median((1 + gap) * (1 + from_open) - 1) AS market, avg(direction * sign((1 + gap) * (1 + from_open) - 1)) AS aligned_breadth, avg((along > 0)::INT) AS continuation FROM j GROUP BY ALL),
 a AS (SELECT m.*, direction, open_energy, open_median, open_breadth, direction * remaining AS aligned_remaining, direction * market AS aligned_total, direction * market - abs(open_median) AS extension FROM m JOIN e USING (date)),
 t AS (SELECT x.*, (SELECT max(y.aligned_remaining) FROM a y WHERE y.date = x.date AND y.horizon <= x.horizon) AS market_mfe, (SELECT min(y.aligned_remaining) FROM a y WHERE y.date = x.date AND y.horizon <= x.horizon) AS market_mae FROM a x),
 p AS (SELECT t.*, (SELECT min(y.horizon) FROM a y WHERE y.date = t.date AND y.horizon <= t.horizon AND y.aligned_remaining = t.market_mfe) AS time_to_peak FROM t),
 q AS (SELECT h.horizon, j.date, j.ticker, max(along) AS up, min(along) AS down FROM (VALUES {", ".join(f"({h})" for h in _H)}) AS h(horizon) JOIN j ON j.horizon <= h.horizon GROUP BY ALL),
 n AS (SELECT date, horizon, CASE WHEN count(*) >= 8 THEN median(up) END AS node_mfe, CASE WHEN count(*) >= 8 THEN median(down) END AS node_mae FROM q GROUP BY ALL)"""
_SHOWN = ["direction", "open_energy", "open_median", "open_breadth", "remaining", "aligned_remaining", "aligned_total", "extension", "aligned_breadth", "continuation", "market_mfe", "market_mae", "node_mfe", "node_mae"]


@register("open_shock_paths", f"WITH {_SHOCK} SELECT date, horizon, time_to_peak, {s6(*_SHOWN)} FROM p JOIN n USING (date, horizon)")
def open_shock_paths(spark, sf_dir):
    w = by()
    o = written(dense(spark, sf_dir).select("ticker", "date", (F.col("open") / F.lag("execution_close").over(w) - 1).alias("gap"), *[(F.lead("close", h - 1).over(w) / F.col("open") - 1).alias(f"h{h}") for h in _H]), "opens")
    closes = o.select("date", "ticker", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"h{h}").alias("from_open")) for h in _H])).alias("x")).select("date", "ticker", "x.*")
    return paths.open_shock(o.select("date", "ticker", "gap"), closes, list(_H), 8).select("date", "horizon", "time_to_peak", *r6(*_SHOWN))


@register(
    "path_peaks",
    f"""WITH {_SHOCK}, s AS (SELECT CASE WHEN date < DATE '1997-01-01' THEN 'fit' ELSE 'test' END AS split, date, horizon, round(abs(remaining), 2) AS x FROM p), k AS (SELECT *, row_number() OVER v AS i, lead(horizon) OVER v AS h2, lead(x) OVER v AS x2 FROM s WINDOW v AS (PARTITION BY split, date ORDER BY x DESC, horizon DESC)),
 f AS (SELECT split, date, x AS path_salience, horizon AS peak_horizon, coalesce(h2, -1) AS second_horizon, CASE WHEN x > 1e-12 THEN (x - x2) / x ELSE 0 END AS relative_margin FROM k WHERE i = 1)
 SELECT split, date, round(path_salience, 6) AS path_salience, peak_horizon, second_horizon, round(relative_margin, 6) AS relative_margin, path_salience >= (SELECT quantile_cont(path_salience, 0.9) FROM f WHERE split = 'fit') AS major_event FROM f""",
)
def path_peaks(spark, sf_dir):
    rows = open_shock_paths(spark, sf_dir).select(F.when(F.col("date") < "1997-01-01", "fit").otherwise("test").alias("split"), "date", "horizon", F.round(F.abs("remaining"), 2).alias("x"))
    p = paths.path_peaks(written(rows, "salience"), "split", "date", "horizon", "x", "fit")
    return p.select("split", "date", *r6("path_salience"), "peak_horizon", "second_horizon", *r6("relative_margin"), "major_event")


@register(
    "selected_peaks",
    f"WITH {DENSE}, k AS (SELECT ticker, date, return_4d, row_number() OVER (PARTITION BY date ORDER BY return_4d DESC, ticker) AS i FROM r WHERE return_4d IS NOT NULL), b AS (SELECT * FROM k WHERE i = 1) SELECT ticker, date, round(return_4d, 6) AS return_4d FROM (SELECT *, row_number() OVER (ORDER BY return_4d DESC, date) AS j, count(*) OVER () AS n FROM b) WHERE j <= greatest(1, ceil(n * 0.2)) AND return_4d >= 0.5",
)
def selected_peaks(spark, sf_dir):
    return paths.selected_peaks(with_returns(spark, sf_dir), "date", "return_4d", "ticker", 0.2, 0.5).select("ticker", "date", *r6("return_4d"))


@register(
    "classification_metrics",
    """WITH x AS (SELECT d.lang, greatest(1e-6, least(1 - 1e-6, d.n_chars / 4000)) AS p, l.quality AS y FROM labels l JOIN documents d USING (doc_id) WHERE d.n_chars IS NOT NULL AND l.quality IS NOT NULL)
 SELECT lang, count(*) AS rows, round(avg(y), 6) AS positive_fraction, round(avg((y - p) ** 2), 6) AS brier, round(CASE WHEN avg((y - 0.6) ** 2) > 1e-12 THEN 1 - avg((y - p) ** 2) / avg((y - 0.6) ** 2) END, 6) AS brier_skill, round(avg(((p >= 0.5)::INT = y)::INT), 6) AS accuracy,
 round((coalesce(avg(CASE WHEN y = 0 THEN (p < 0.5)::INT END), avg(CASE WHEN y = 1 THEN (p >= 0.5)::INT END)) + coalesce(avg(CASE WHEN y = 1 THEN (p >= 0.5)::INT END), avg(CASE WHEN y = 0 THEN (p < 0.5)::INT END))) / 2, 6) AS balanced_accuracy FROM x GROUP BY lang""",
)
def classification_metrics(spark, sf_dir):
    x = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id").withColumn("p", F.col("n_chars") / 4000)
    return paths.classification(x, "lang", "p", "quality", F.lit(0.6)).select("lang", "rows", *r6("positive_fraction", "brier", "brier_skill", "accuracy", "balanced_accuracy"))


_SIGNALS = ("return_1d", "return_4d", "value", "volume")


@register(
    "positive_ic_weights",
    f"WITH {DENSE}, y AS (SELECT *, lead(return_1d) OVER (PARTITION BY ticker ORDER BY date) AS t FROM r), u AS ("
    + " UNION ALL ".join(f"SELECT '{s}' AS signal, date, CASE WHEN count(*) >= 3 AND stddev_pop({s}) > 1e-12 AND stddev_pop(t) > 1e-12 THEN corr({s}, t) END AS ic FROM y WHERE {s} IS NOT NULL AND t IS NOT NULL GROUP BY date" for s in _SIGNALS)
    + "), m AS (SELECT signal, avg(ic) AS mean_ic FROM u GROUP BY signal) SELECT signal, round(mean_ic, 6) AS mean_ic, round(CASE WHEN sum(greatest(mean_ic, 0)) OVER () > 1e-12 THEN greatest(mean_ic, 0) / sum(greatest(mean_ic, 0)) OVER () ELSE 1.0 / count(*) OVER () END, 6) AS weight FROM m",
)
def positive_ic_weights(spark, sf_dir):
    y = written(with_returns(spark, sf_dir).withColumn("t", F.lead("return_1d").over(by())).select("ticker", "date", *_SIGNALS, "t"), "signals")
    daily = [metrics.daily_ic(y, s, "t").select(F.lit(s).alias("signal"), "ic") for s in _SIGNALS]
    every = daily[0]
    for d in daily[1:]:
        every = every.union(d)
    return paths.positive_ic_weights(every, "signal", "ic").select("signal", *r6("mean_ic", "weight"))


@register(
    "signal_correlations",
    f"WITH {DENSE}, "
    + ", ".join(f"c{i} AS (SELECT CASE WHEN count(*) >= 11 AND stddev_pop({a}) > 1e-12 AND stddev_pop({b}) > 1e-12 THEN corr({a}, {b}) END AS c FROM r WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY date)" for i, (a, b) in enumerate(paths.combinations(_SIGNALS, 2)))
    + " "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(c) AS dates, round(avg(c), 6) AS correlation FROM c{i} HAVING count(c) > 0" for i, (a, b) in enumerate(paths.combinations(_SIGNALS, 2))),
)
def signal_correlations(spark, sf_dir):
    return paths.signal_correlations(with_returns(spark, sf_dir), list(_SIGNALS)).select("a", "b", "dates", *r6("correlation"))


@register("fold_percentiles", f"WITH {DENSE} SELECT ticker, date, year(date) AS fold, round((rank() OVER w + (count(*) OVER (PARTITION BY year(date), round(return_1d, 2)) - 1) / 2.0) / count(*) OVER (PARTITION BY year(date)), 6) AS percentile FROM r WHERE return_1d IS NOT NULL WINDOW w AS (PARTITION BY year(date) ORDER BY round(return_1d, 2))")
def fold_percentiles(spark, sf_dir):
    """Place of each rounded return among its year's, ties at their average; counted by value first, so that a fold is no single task."""
    r = written(with_returns(spark, sf_dir).where("return_1d is not null").select("ticker", "date", F.year("date").alias("fold"), F.round("return_1d", 2).alias("x")), "folds")
    g = running_sums(r.groupBy("fold", "x").agg(F.count("*").alias("n")), ["fold"], [F.col("x")], {"upto": "n"})
    total = r.groupBy("fold").agg(F.count("*").alias("total"))
    p = g.join(total, "fold").select("fold", "x", ((F.col("upto") - (F.col("n") - 1) / 2) / F.col("total")).alias("percentile"))
    return r.join(p, ["fold", "x"]).select("ticker", "date", "fold", *r6("percentile"))
