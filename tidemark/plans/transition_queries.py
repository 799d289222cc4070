"""Queries of market transitions, ownership, edge unions and the consensus of two sources."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..catalog import register
from ..operators import consensus, edges, panel, transition
from ..operators.frames import by, last_rows
from ..sources.readers import parquet_table as table
from ..sources.shared import written
from .panel_queries import BARS, DENSE, r6, s6, weekly, with_returns

_Z = "(volume - avg(volume) OVER e) / nullif(stddev_samp(volume) OVER e, 0)"
_STATE = f"""{DENSE}, m AS (SELECT r.*, avg(return_1d) OVER (PARTITION BY date) AS market, close * volume AS turnover FROM r),
 z AS (SELECT ticker, date, lead(execution_close, 4) OVER (PARTITION BY ticker ORDER BY date) / execution_close - 1 AS path, return_1d, return_4d, close / nullif(open, 0) - 1 AS body, {_Z} AS volume_z, (turnover - avg(turnover) OVER e) / nullif(stddev_samp(turnover) OVER e, 0) AS value_z, CASE WHEN isfinite(corr(return_1d, market) OVER e) THEN corr(return_1d, market) OVER e END AS mc FROM m WINDOW e AS (PARTITION BY ticker ORDER BY date ROWS 7 PRECEDING)),
 y AS (SELECT *, lead(return_1d, 4) OVER w AS r1n, lead(return_4d, 4) OVER w AS r4n, lead(body, 4) OVER w AS bn, lead(volume_z, 4) OVER w AS vn, lead(value_z, 4) OVER w AS wn, lead(mc, 4) OVER w AS mn FROM z WINDOW w AS (PARTITION BY ticker ORDER BY date)),
 x AS (SELECT *, r1n - return_1d AS d1, r4n - return_4d AS d2, bn - body AS d3, vn - volume_z AS d4, vn - volume_z AS dv, wn - value_z AS dw FROM y),
 n AS (SELECT *, (d1 IS NOT NULL)::INT + (d2 IS NOT NULL)::INT + (d3 IS NOT NULL)::INT + (d4 IS NOT NULL)::INT AS k, coalesce(d1 * d1, 0) + coalesce(d2 * d2, 0) + coalesce(d3 * d3, 0) + coalesce(d4 * d4, 0) AS sq FROM x),
 g AS (SELECT date, CASE WHEN count(path) >= 4 THEN count(path) ELSE 0 END AS observed_nodes, CASE WHEN count(path) >= 4 THEN avg(path) END AS market_return, CASE WHEN count(path) >= 4 THEN median(path) END AS median_return,
  CASE WHEN count(path) >= 4 THEN median(abs(path)) END AS median_absolute_return, CASE WHEN count(path) >= 4 THEN quantile_cont(abs(path), 0.75) END AS q75_absolute_return, CASE WHEN count(path) >= 4 THEN avg(sign(path)) END AS return_breadth,
  CASE WHEN count(path) >= 4 THEN max(path * path) / sum(path * path) END AS return_concentration, sqrt(sum(sq) / nullif(sum(k), 0)) AS total_state_energy,
  CASE WHEN count(*) FILTER (WHERE k >= 3) >= 4 THEN median(sqrt(sq / k)) FILTER (WHERE k >= 3) END AS node_state_median_energy, CASE WHEN count(*) FILTER (WHERE k >= 3) >= 4 THEN quantile_cont(sqrt(sq / k), 0.75) FILTER (WHERE k >= 3) END AS node_state_q75_energy,
  CASE WHEN count(*) FILTER (WHERE k >= 3) >= 4 THEN avg((sqrt(sq / k) >= 0.75)::INT) FILTER (WHERE k >= 3) END AS state_change_participation, CASE WHEN count(mn) >= 4 THEN median(mn) END AS market_corr_level, CASE WHEN count(mc) >= 4 THEN median(mc) END AS c0,
  CASE WHEN count(vn) >= 4 THEN median(vn) END AS volume_median_z, CASE WHEN count(vn) >= 4 THEN quantile_cont(vn, 0.75) END AS volume_q75_z, CASE WHEN count(vn) >= 4 THEN avg((vn >= 1)::INT) END AS volume_participation_z1, CASE WHEN count(dv) >= 4 THEN median(dv) END AS volume_delta_median_z,
  CASE WHEN count(wn) >= 4 THEN median(wn) END AS value_median_z, CASE WHEN count(wn) >= 4 THEN quantile_cont(wn, 0.75) END AS value_q75_z, CASE WHEN count(wn) >= 4 THEN avg((wn >= 1)::INT) END AS value_participation_z1, CASE WHEN count(dw) >= 4 THEN median(dw) END AS value_delta_median_z,
  [CASE WHEN count(d1) >= 4 THEN median(d1) END, CASE WHEN count(d2) >= 4 THEN median(d2) END, CASE WHEN count(d3) >= 4 THEN median(d3) END, CASE WHEN count(d4) >= 4 THEN median(d4) END] AS cs FROM n GROUP BY date),
 h AS (SELECT *, list_filter(cs, lambda c: c IS NOT NULL) AS us FROM g),
 q AS (SELECT *, CASE WHEN median_absolute_return > 1e-12 THEN greatest(-1, least(1, median_return / median_absolute_return)) WHEN median_absolute_return IS NOT NULL THEN 0 END AS robust_return_coherence,
  sqrt(list_sum(list_transform(us, lambda c: c * c)) / nullif(len(us), 0)) AS common_state_energy, len(list_filter(us, lambda c: abs(c) >= 0.25)) / nullif(len(us), 0) AS state_feature_breadth, market_corr_level - c0 AS market_corr_change FROM h),
 components AS (SELECT *, CASE WHEN common_state_energy IS NOT NULL THEN CASE WHEN total_state_energy > 1e-12 THEN common_state_energy / total_state_energy WHEN total_state_energy = 0 THEN 0 END END AS state_coherence FROM q)"""


def _state(spark, sf_dir):
    p = panel.with_market(with_returns(spark, sf_dir)).withColumn("turnover", F.col("close") * F.col("volume"))
    e, both = last_rows(8), F.col("return_1d").isNotNull() & F.col("market").isNotNull()
    z = lambda x: panel.ratio(F.col(x) - F.avg(x).over(e), F.stddev_samp(x).over(e))
    s = p.select("ticker", "date", (F.lead("execution_close", 4).over(by()) / F.col("execution_close") - 1).alias("path"), "return_1d", "return_4d", (panel.ratio(F.col("close"), F.col("open")) - 1).alias("body"), z("volume").alias("volume_z"), z("turnover").alias("value_z"), panel.pearson(F.when(both, F.col("return_1d")), F.when(both, F.col("market")), e).alias("mc"))
    return s.withColumns({f"{c}_next": F.lead(c, 4).over(by()) for c in ("return_1d", "return_4d", "body", "volume_z", "value_z", "mc")})


def _components(spark, sf_dir):
    return transition.components(_state(spark, sf_dir), ["return_1d", "return_4d", "body", "volume_z"], "path", "volume_z", "value_z", "mc", least=4)


_SHOWN = ["market_return", "return_concentration", "total_state_energy", *transition.COMPONENTS]


@register("transition_components", f"WITH {_STATE} SELECT date, observed_nodes, {s6(*_SHOWN)} FROM components")
def transition_components(spark, sf_dir):
    return _components(spark, sf_dir).select("date", F.col("observed_nodes").cast("long").alias("observed_nodes"), *r6(*_SHOWN))


_MAG = {c: (f"abs({c})" if c in transition.SIGNLESS else f"CASE WHEN {c} IS NOT NULL THEN greatest({c}, 0) END") for c in transition.COMPONENTS}
_FIT = (
    f"{_STATE}, mags AS (SELECT date, median_return, return_breadth, {', '.join(f'{m} AS {c}' for c, m in _MAG.items() if c not in ('median_return', 'return_breadth'))}, abs(median_return) AS mm, abs(return_breadth) AS mb FROM components),"
    f" fit AS (SELECT * FROM mags WHERE date < DATE '1997-01-01'), cal AS (SELECT quantile_cont(median_return, 0.1) AS sr, quantile_cont(return_breadth, 0.1) AS sb, "
    + ", ".join(f"median({x}) AS c_{c}, CASE WHEN quantile_cont({x}, 0.9) - median({x}) > 1e-12 THEN quantile_cont({x}, 0.9) - median({x}) WHEN stddev_pop({x}) > 1e-12 THEN stddev_pop({x}) ELSE 1 END AS s_{c}" for c in transition.COMPONENTS for x in [{"median_return": "mm", "return_breadth": "mb"}.get(c, c)])
    + " FROM fit), sc AS (SELECT date, median_return, return_breadth, "
    + ", ".join(
        f"sqrt(({' + '.join(f'greatest(0, least(20, ({ {'median_return': 'mm', 'return_breadth': 'mb'}.get(c, c) } - c_{c}) / s_{c})) ** 2 + CASE WHEN { {'median_return': 'mm', 'return_breadth': 'mb'}.get(c, c) } IS NULL THEN NULL ELSE 0 END' for c in names)}) / {len(names)}) AS f_{f}"
        for f, names in transition.FAMILIES.items()
    )
    + ", sr, sb FROM mags CROSS JOIN cal), th AS (SELECT "
    + ", ".join(f"quantile_cont(f_{f}, 0.95) AS t_{f}" for f in transition.FAMILIES)
    + " FROM sc WHERE date < DATE '1997-01-01'), lab AS (SELECT *, coalesce(median_return <= sr AND return_breadth <= sb, false) AS broad_selloff, "
    + ", ".join(f"coalesce(f_{f} >= t_{f}, false) AS {e}" for f, e in transition.EVENTS.items())
    + ", CASE WHEN "
    + " AND ".join(f"f_{f} IS NOT NULL" for f in transition.FAMILIES)
    + f" THEN greatest({', '.join(f'f_{f} / greatest(t_{f}, 1e-12)' for f in transition.FAMILIES)}, CASE WHEN coalesce(median_return <= sr AND return_breadth <= sb, false) THEN 1 ELSE 0 END) END AS systemic_impact, "
    + " CASE WHEN "
    + " AND ".join(f"f_{f} IS NOT NULL" for f in transition.FAMILIES)
    + f" THEN greatest({', '.join(f'f_{f}' for f in transition.FAMILIES)}) END AS systemic_energy FROM sc CROSS JOIN th)"
)


@register(
    "systemic_transitions",
    f"WITH {_FIT} SELECT date, {', '.join(transition.EVENTS.values())}, broad_selloff, {' OR '.join(transition.EVENTS.values())} OR broad_selloff AS systemic_event, {s6('systemic_impact', 'systemic_energy')}, {', '.join(f'round(f_{f}, 6) AS family_{f}' for f in transition.FAMILIES)} FROM lab",
)
def systemic_transitions(spark, sf_dir):
    """Labels of all dates by a calibration on those before 1997."""
    rows = written(_components(spark, sf_dir), "components")
    fitted = written(transition.calibration(rows.where("date < DATE '1997-01-01'")), "calibration")
    got = transition.labelled(rows, fitted)
    return got.select("date", *transition.EVENTS.values(), "broad_selloff", "systemic_event", *r6("systemic_impact", "systemic_energy", *[f"family_{f}" for f in transition.FAMILIES]))


# Disclosures: orders of a customer about another one, the stake from the price
_STAKES = """f AS (SELECT o_custkey % 40 AS holder, (o_custkey * 7 + o_orderkey) % 40 AS target, CAST(o_orderdate AS DATE) AS date, (o_orderkey % 113) * 1.0 AS ratio FROM orders WHERE o_orderkey % 3 = 0),
 d AS (SELECT DISTINCT CAST(date_trunc('week', l_shipdate) AS DATE) AS date FROM lineitem), s AS (SELECT holder, target, f.date, least(ratio, 100) / 100 AS ratio, d.date AS session FROM f ASOF JOIN d ON f.date <= d.date WHERE holder <> target AND ratio > 0),
 l AS (SELECT holder, target, session, arg_max(ratio, (date, ratio)) AS ratio FROM s GROUP BY ALL),
 stakes AS (SELECT *, max(ratio) OVER (PARTITION BY holder, target) AS most, lead(session) OVER (PARTITION BY holder, target ORDER BY session) AS until FROM l)"""


def _stakes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0")  # what counts as a disclosure
    f = o.select((F.col("o_custkey") % 40).alias("holder"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % 40).alias("target"), F.col("o_orderdate").cast("date").alias("date"), (F.col("o_orderkey") % 113).cast("string").alias("ratio"))
    d = table(spark, sf_dir, "lineitem").select(F.date_trunc("week", "l_shipdate").cast("date").alias("date")).distinct()
    return edges.ownership_stakes(f, d, 0.5)


@register("ownership_stakes", f'WITH {_STAKES} SELECT holder, target, round(ratio, 6) AS ratio, session AS since, "until" FROM stakes WHERE most >= 0.5')
def ownership_stakes(spark, sf_dir):
    return _stakes(spark, sf_dir).select("holder", "target", *r6("ratio"), "since", "until")


@register(
    "edge_union",
    f"""WITH {_STAKES}, a AS (SELECT * FROM stakes WHERE most >= 0.5 AND session <= DATE '1997-06-02' AND ("until" IS NULL OR "until" > DATE '1997-06-02')), u AS (SELECT target AS src, holder AS dst, ratio * 0.3333 AS w FROM a UNION ALL SELECT holder, target, ratio * 0.3333 FROM a
  UNION ALL SELECT holder, target, ratio / 7 FROM a WHERE holder < 5) SELECT src, dst, round_even(w, 4) AS weight FROM u""",
)
def edge_union(spark, sf_dir):
    s = written(_stakes(spark, sf_dir), "stakes")
    on = F.to_date(F.lit("1997-06-02"))
    e = edges.ownership_edges(s, on, 0.3333)
    extra = s.where((F.col("since") <= on) & (F.col("until").isNull() | (F.col("until") > on)) & (F.col("holder") < 5)).select(F.col("holder").alias("src"), F.col("target").alias("dst"), (F.col("ratio") / 7).alias("weight"))
    return edges.edge_union(e, extra)


@register(
    "source_consensus",
    f"""WITH {BARS}, o AS (SELECT ticker, date, close, volume, close * (1 + CASE WHEN day(date) % 5 = 0 THEN 0.01 ELSE 0.0001 END) AS c2, volume * (1 + (day(date) % 4) * 0.03) AS v2 FROM bars),
 d AS (SELECT *, abs(close - c2) / abs(c2) AS cd, abs(volume - v2) / greatest(abs(v2), 1) AS vd FROM o), e AS (SELECT *, cd <= 0.001 AS cv, vd <= 0.05 AS vv, CASE WHEN vd <= 0.05 THEN ln(1 + v2) END AS lv FROM d),
 f AS (SELECT *, CASE WHEN cv AND lag(cv) OVER w THEN ln(c2 * 0.9) - ln(lag(c2) OVER w * 0.9) END AS lr, CASE WHEN count(lv) OVER p >= 10 THEN median(lv) OVER p END AS b, count(lv) OVER p AS n FROM e WINDOW w AS (PARTITION BY ticker ORDER BY date), p AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
 SELECT ticker, date, cv AS close_valid, vv AS volume_valid, {s6('cd', 'vd', 'lr', 'b').replace('AS cd', 'AS close_difference').replace('AS vd', 'AS volume_difference').replace('AS lr', 'AS log_return').replace('AS b', 'AS volume_baseline')}, n AS volume_observations, round(lv - b, 6) AS volume_shock, lr IS NOT NULL AS return_valid, lv - b IS NOT NULL AS volume_feature_valid FROM f""",
)
def source_consensus(spark, sf_dir):
    a = written(weekly(spark, sf_dir).select("ticker", "date", "close", "volume"), "bars")
    b = a.select("ticker", "date", (F.col("close") * (1 + F.when(F.dayofmonth("date") % 5 == 0, 0.01).otherwise(0.0001))).alias("close"), (F.col("volume") * (1 + F.dayofmonth("date") % 4 * 0.03)).alias("volume")).withColumn("adjusted_close", F.col("close") * 0.9)
    return consensus.consensus(a, b).select("ticker", "date", "close_valid", "volume_valid", *r6("close_difference", "volume_difference", "log_return", "volume_baseline"), "volume_observations", *r6("volume_shock"), "return_valid", "volume_feature_valid")


