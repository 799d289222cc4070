"""Queries of event frames: the events table as scored market events of its users."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..operators import event_frames as ef
from ..sources.readers import parquet_table as table
from ..sources.shared import written
from .panel_queries import half6, r6

_DELTA = "struct<node:string,delta:double,confidence:double>"
_EDGE = "struct<src:string,dst:string,edge_type:string,delta_weight:double,confidence:double>"


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i, v, k = F.col("event_id"), F.col("value"), F.get_json_object("props", "$.k").cast("long")
    d = lambda *xs: F.struct(*xs).cast(_DELTA)
    s = lambda *xs: F.struct(*xs).cast(_EDGE)
    user = F.col("user_id").cast("string")
    next_user = (F.col("user_id") + 1).cast("string")
    theme = F.concat(F.lit("Theme \t "), (k % 20).cast("string"))
    none = F.lit(None).cast("double")
    return e.select(
        i.alias("seq"), F.col("user_id").alias("ticker"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("day "), F.col("ts").cast("date").cast("string"))).when(F.col("event_type") != "view", i.cast("string")).alias("event_id"),
        F.col("ts").cast("date").alias("event_date"), F.when(i % 5 == 0, F.date_add(F.col("ts").cast("date"), 1)).alias("effective_session"),
        F.when(i % 7 != 0, k / 100).alias("relevance"), F.when(i % 13 != 0, i % 11 / 10).alias("specificity"), (0.5 + i % 6 / 10).alias("quality"),
        ((i % 3) - 1).cast("double").alias("polarity"), (v / 10).alias("magnitude"), (i % 10 / 8).alias("confidence"), F.when(i % 9 == 0, 0.3 - v / 50).alias("score_contribution"),
        F.when(i % 4 == 0, F.array(d(user, v / 20 - 0.4, none), d(user, v / 40, F.lit(1.5)), d(next_user, v, none))).alias("node_deltas"),
        F.when(i % 3 == 0, F.array(s(theme, user, F.lit("x"), v / 30, none), s(F.lit("Other"), next_user, F.lit("x"), v, none), s(F.lit("Broad"), next_user, F.lit("Theme_Exposure"), v, none))).alias("edge_deltas"),
        F.when(i % 2 == 0, F.array(F.concat(F.lit(" RAW "), (k % 5).cast("string")))).alias("raw_themes"), F.array(F.concat(F.lit("Sector  "), (k % 8).cast("string")), F.lit("")).alias("themes"),
        F.array(F.lit("A005930 corp"), F.concat(F.lit("Region "), (F.col("user_id") % 5).cast("string"))).alias("affected_nodes"), F.col("event_type"),
    )


def _sessions(spark, sf_dir):
    d = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("date")).distinct()
    return d.where(F.weekday("date") < 5)


_ACCEPTED = """d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t FROM (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events WHERE isodow(ts) < 6)),
 e AS (SELECT event_id AS seq, user_id AS ticker, event_type, CAST(ts AS DATE) AS day, value AS v, CAST(props ->> '$.k' AS BIGINT) AS k, event_id % 10 / 8 AS conf,
  CASE WHEN event_id % 7 <> 0 THEN CAST(props ->> '$.k' AS BIGINT) / 100 END AS rel, CASE WHEN event_id % 13 <> 0 THEN event_id % 11 / 10 END AS spec, 0.5 + event_id % 6 / 10 AS quality FROM events),
 f AS (SELECT *, greatest(0, least(1, coalesce(rel, 1))) * greatest(0, least(1, coalesce(spec, 1))) * greatest(0, least(1, quality)) AS mass,
  CASE WHEN seq % 5 = 0 THEN (SELECT count(*) FROM d WHERE d.date < day + 1) ELSE (SELECT count(*) FROM d WHERE d.date < day) + 1 END AS t FROM e WHERE rel IS NULL OR (rel >= 0.5 AND (spec IS NULL OR spec >= 0.5))),
 q AS (SELECT * FROM f WHERE mass > 0 AND t < (SELECT count(*) FROM d)
  QUALIFY event_type = 'view' OR event_type <> 'error' OR row_number() OVER (PARTITION BY ticker, event_type, day ORDER BY seq) = 1),
 z AS (SELECT *, CASE WHEN seq % 4 = 0 THEN (v / 20 - 0.4) * conf + v / 40 * 1.5 ELSE ((seq % 3) - 1) * v / 10 * conf END AS first, CASE WHEN seq % 4 = 0 THEN abs((v / 20 - 0.4) * conf) + v / 40 * 1.5 ELSE abs(((seq % 3) - 1) * v / 10 * conf) END AS first_abs,
  CASE WHEN seq % 4 = 0 THEN (least(conf, 1) + 1) / 2 ELSE least(conf, 1) END AS sure FROM q),
 y AS (SELECT *, CASE WHEN seq % 9 = 0 THEN 0.3 - v / 50 ELSE first END AS score FROM z),
 accepted AS (SELECT *, greatest(score, 0) AS pos, greatest(-score, 0) AS neg, greatest(first_abs, abs(score)) AS absolute FROM y)"""


@register(
    "event_frames",
    f"""WITH RECURSIVE {_ACCEPTED}, g AS (SELECT ticker, t, sum(score) AS score, sum(mass) AS n, sum(pos) AS pos, sum(neg) AS neg, sum(absolute) AS a, sum(sure) AS c FROM accepted GROUP BY ALL),
 j AS (SELECT u.ticker, d.date, d.t, greatest(-1, least(1, coalesce(score, 0) / sqrt(greatest(coalesce(n, 0), 1)))) AS s, greatest(0, least(1, coalesce(a, 0) / sqrt(greatest(coalesce(n, 0), 1)))) AS a, greatest(0, least(1, coalesce(pos, 0) / sqrt(greatest(coalesce(n, 0), 1)))) AS pos,
  greatest(0, least(1, coalesce(neg, 0) / sqrt(greatest(coalesce(n, 0), 1)))) AS neg, coalesce(n, 0) AS n, coalesce(c / nullif(n, 0), 0) AS c FROM (SELECT DISTINCT user_id AS ticker FROM events) u CROSS JOIN d LEFT JOIN g ON g.ticker = u.ticker AND g.t = d.t),
 r AS (SELECT ticker, t, CAST(s AS DOUBLE) AS s, CAST(a AS DOUBLE) AS a, CAST(n AS DOUBLE) AS n FROM j WHERE t = 0 UNION ALL SELECT j.ticker, j.t, j.s + 0.5 ** 0.2 * r.s, j.a + 0.5 ** 0.2 * r.a, j.n + 0.5 ** 0.2 * r.n FROM r JOIN j ON j.ticker = r.ticker AND j.t = r.t + 1)
 SELECT j.ticker, date, round(j.s, 6) AS news_score_1d, round(CASE WHEN abs(r.s) < 0.5 ** 12 * 1e-3 THEN 0 ELSE r.s END, 6) AS news_score_decay, round(CASE WHEN r.a < 0.5 ** 12 * 1e-3 THEN 0 ELSE r.a END, 6) AS news_abs_decay,
 round(ln(1 + CASE WHEN r.n < 0.5 ** 12 * 1e-3 THEN 0 ELSE r.n END), 6) AS news_count_decay, round(sum(j.n) OVER (PARTITION BY j.ticker ORDER BY j.t ROWS 2 PRECEDING), 6) AS news_count_3d, round(sum(j.n) OVER (PARTITION BY j.ticker ORDER BY j.t ROWS 9 PRECEDING), 6) AS news_count_10d,
 round(sum(pos) OVER (PARTITION BY j.ticker ORDER BY j.t ROWS 2 PRECEDING), 6) AS news_pos_3d, round(sum(neg) OVER (PARTITION BY j.ticker ORDER BY j.t ROWS 2 PRECEDING), 6) AS news_neg_3d, round(c, 6) AS news_confidence_1d FROM j JOIN r ON r.ticker = j.ticker AND r.t = j.t""",
)
def event_frames(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("ticker"))
    return ef.event_frames(e, _sessions(spark, sf_dir), _events(spark, sf_dir), digits=None).select("ticker", "date", *half6(*ef.NAMES))


_THEMES = f"""{_ACCEPTED}, l AS (SELECT *, list_concat(
   CASE WHEN seq % 3 = 0 THEN ['theme ' || k % 20, 'broad'] ELSE [] END, CASE WHEN seq % 2 = 0 THEN ['raw ' || k % 5] ELSE [] END, ['sector ' || k % 8, 'region ' || ticker % 5], ['event:' || event_type]) AS themes FROM accepted),
 w AS (SELECT seq, ticker, t, mass, themes, least(2, CASE WHEN s > 0 THEN s ELSE greatest(absolute, 0.05 * mass) END) AS strength FROM (SELECT *, CASE WHEN seq % 3 = 0 THEN v / 30 * greatest(0, least(1, sure)) ELSE absolute * greatest(0, least(1, sure)) END AS s FROM l)),
 n AS (SELECT seq, mass, unnest(themes) AS theme, generate_subscripts(themes, 1) AS i FROM w),
 vocabulary AS (SELECT theme, sum(mass) AS mass, row_number() OVER (ORDER BY round(sum(mass), 9) DESC, min((seq, i))) - 1 AS place FROM n GROUP BY theme HAVING sum(mass) >= 2 ORDER BY round(sum(mass), 9) DESC, min((seq, i)) LIMIT 24)"""


def _vocabulary(spark, sf_dir, sessions=None):
    e = ef.accepted(_events(spark, sf_dir), sessions or _sessions(spark, sf_dir))
    return ef.theme_vocabulary(e.withColumn("all_themes", ef.themes_of(e)), 24)


@register("theme_vocabulary", f"WITH {_THEMES} SELECT theme, round(mass, 6) AS mass, place FROM vocabulary")
def theme_vocabulary(spark, sf_dir):
    return _vocabulary(spark, sf_dir).select("theme", F.round("mass", 6).alias("mass"), F.col("place").cast("long").alias("place"))


_EXPOSURE = f"""{_THEMES}, m AS (SELECT seq, w.ticker, w.t, strength, theme FROM (SELECT *, unnest(themes) AS theme FROM w) AS w SEMI JOIN vocabulary USING (theme)),
 x AS (SELECT ticker, t, theme, sum(strength / sqrt(n)) AS x FROM (SELECT *, count(*) OVER (PARTITION BY seq) AS n FROM m) GROUP BY ALL),
 exposure AS (SELECT x.ticker, d.t, d.date, x.theme, sum(x.x * 0.5 ** ((d.t - x.t) / 5)) AS exposure FROM x JOIN d ON d.t >= x.t GROUP BY ALL HAVING exposure >= 0.5 ** 12 * 1e-3)"""


@register("theme_exposure", f"WITH {_EXPOSURE} SELECT ticker, date, theme, round(exposure, 6) AS exposure FROM exposure")
def theme_exposure(spark, sf_dir):
    return ef.theme_exposure(_sessions(spark, sf_dir), _events(spark, sf_dir), most=24).select("ticker", "date", "theme", *half6("exposure"))


@register(
    "theme_edges",
    f"""WITH {_EXPOSURE}, unit AS (SELECT ticker, theme, exposure / sqrt(sum(exposure ** 2) OVER (PARTITION BY ticker)) AS x FROM exposure WHERE t = (SELECT max(t) FROM d)),
 c AS (SELECT a.ticker AS src, b.ticker AS dst, round_even(sum(a.x * b.x), 9) AS w FROM unit AS a JOIN unit AS b ON a.theme = b.theme AND a.ticker <> b.ticker GROUP BY ALL)
 SELECT src, dst, round(w * 0.25, 6) AS weight FROM c WHERE w >= 0.05 QUALIFY row_number() OVER (PARTITION BY src ORDER BY w DESC, dst DESC) <= 4""",
)
def theme_edges(spark, sf_dir):
    sessions = written(_sessions(spark, sf_dir), "sessions")
    last = sessions.agg(F.max("date").alias("date"))  # one row
    x = ef.theme_exposure(sessions, _events(spark, sf_dir), most=24).join(F.broadcast(last), "date")
    return ef.theme_edges(x, written(_vocabulary(spark, sf_dir, sessions), "vocabulary")).select("src", "dst", *r6("weight"))
