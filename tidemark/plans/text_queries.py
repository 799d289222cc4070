"""Queries of names in texts, near titles, leaders, and of the session clock."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..operators import aliases, clock, leaders, titles
from ..sources.readers import parquet_table as table
from ..sources.shared import written
from .panel_queries import r6

# Aliases: the first one to three words of each benchmark passage, its first three letters and its first word among others' names; valid
# for a part of the days that documents are dealt to.
_ALIASES = """b AS (SELECT item_id AS i, string_split(regexp_replace(lower(text), '[^0-9a-z]+', ' ', 'g').trim(), ' ') AS w FROM benchmark),
 a AS (SELECT i % 15 AS ticker, array_to_string(w[1:1 + i % 3], '-') AS alias, ['legal_name', 'brand', 'affiliate'][i % 3 + 1] AS alias_type, 0.5 + (i % 5) / 10 AS confidence,
   CASE WHEN i % 4 <> 0 THEN DATE '2024-01-01' + CAST(i % 20 AS INT) END AS valid_from, CASE WHEN i % 5 <> 0 THEN DATE '2024-02-01' + CAST(i % 25 AS INT) END AS valid_to FROM b
  UNION ALL SELECT i % 15, left(w[1], 3), 'abbreviation', 0.9, NULL, DATE '2024-02-10' FROM b UNION ALL SELECT i % 15, upper(w[2]), 'former_name', NULL, DATE '2024-01-20', NULL FROM b),
 names AS (SELECT DISTINCT *, lower(alias) AS raw, regexp_replace(lower(alias), '[^0-9a-z]+', '', 'g') AS c FROM a WHERE alias <> '')"""


def _aliases(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("i"), F.split(F.trim(F.regexp_replace(F.lower("text"), "[^0-9a-z]+", " ")), " ").alias("w"))
    i, ticker = F.col("i"), (F.col("i") % 15).alias("ticker")
    date = lambda d, n: F.date_add(F.to_date(F.lit(d)), n.cast("int"))
    none = F.lit(None).cast("date")
    named = lambda alias, kind, confidence, a, z: (ticker, alias.alias("alias"), kind.alias("alias_type"), confidence.cast("double").alias("confidence"), a.alias("valid_from"), z.alias("valid_to"))
    kind = F.element_at(F.array(F.lit("legal_name"), F.lit("brand"), F.lit("affiliate")), (i % 3 + 1).cast("int"))
    long = b.select(*named(F.array_join(F.slice("w", 1, (i % 3 + 1).cast("int")), "-"), kind, 0.5 + i % 5 / 10, F.when(i % 4 != 0, date("2024-01-01", i % 20)), F.when(i % 5 != 0, date("2024-02-01", i % 25))))
    short = b.select(*named(F.substring(F.col("w")[0], 1, 3), F.lit("abbreviation"), F.lit(0.9), none, F.to_date(F.lit("2024-02-10"))))
    second = b.select(*named(F.upper(F.get("w", F.lit(1))), F.lit("former_name"), F.lit(None), F.to_date(F.lit("2024-01-20")), none))
    return long.union(short).union(second).where("alias != ''").distinct()


@register(
    "alias_matches",
    f"""WITH {_ALIASES}, t AS (SELECT doc_id, DATE '2024-01-01' + CAST(doc_id % 60 AS INT) AS day, lower(trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS x FROM documents WHERE text NOT LIKE '%&%'),
 u AS (SELECT *, regexp_replace(x, '[^0-9a-z가-힣]+', '', 'g') AS xc FROM t),
 h AS (SELECT doc_id, names.* FROM u JOIN names ON (valid_from IS NULL OR day >= valid_from) AND (valid_to IS NULL OR day <= valid_to) AND contains(xc, c)
  AND (length(c) > 4 OR regexp_matches(x, '(^|[^0-9a-z])' || replace(raw, '-', '\\-') || '($|[^0-9a-z])')))
 SELECT doc_id, ticker, alias, CASE WHEN alias_type IN ('legal_name', 'abbreviation', 'former_name') THEN 'identity' ELSE 'related_entity' END AS relationship, round(confidence, 6) AS confidence FROM h
 QUALIFY row_number() OVER (PARTITION BY doc_id, ticker ORDER BY alias_type IN ('legal_name', 'abbreviation', 'former_name') DESC, coalesce(confidence, 0) DESC, length(c) DESC, alias DESC) = 1""",
)
def alias_matches(spark, sf_dir):
    """Best alias of each entity in each whole document; documents with character references are left to the operator's tests, since SQL does not resolve them."""
    d = table(spark, sf_dir, "documents").where(~F.contains("text", F.lit("&"))).select("doc_id", "text", F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("doc_id") % 60).cast("int")).alias("day"))
    return aliases.alias_matches(d, written(_aliases(spark, sf_dir), "aliases"), "doc_id", "text", "day").select("doc_id", "ticker", "alias", "relationship", *r6("confidence"))


@register(
    "alias_registry_faults",
    f"""WITH {_ALIASES}, k AS (SELECT ticker, alias, c, alias_type, confidence, valid_from, valid_to, count(*) OVER (PARTITION BY ticker, c, alias_type, valid_from, valid_to) AS same FROM names), o AS (SELECT c, count(DISTINCT ticker) AS owners FROM names GROUP BY c)
 SELECT 'too short' AS fault, ticker, alias FROM k WHERE length(c) < 2 UNION ALL SELECT 'confidence', ticker, alias FROM k WHERE confidence IS NULL UNION ALL SELECT 'validity', ticker, alias FROM k WHERE valid_from > valid_to
 UNION ALL SELECT 'repeated', ticker, alias FROM k WHERE same > 1 UNION ALL SELECT 'ambiguous', ticker, alias FROM k JOIN o USING (c) WHERE owners > 1""",
)
def alias_registry_faults(spark, sf_dir):
    return aliases.registry_faults(_aliases(spark, sf_dir))


def _titled(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 3).alias("day"), F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"))
    return p.where("title is not null")


@register("near_titles")
def near_titles(spark, sf_dir):
    """Near-duplicate titles of pages by matching blocks, which SQL does not express."""
    return titles.near_titles(_titled(spark, sf_dir), "page_id", "day", "title").select("key", "other", *r6("ratio"))


@register("title_clusters")
def title_clusters(spark, sf_dir):
    return titles.title_clusters(_titled(spark, sf_dir), "page_id", "day", "title")


@register("leader_clusters")
def leader_clusters(spark, sf_dir):
    """Vectors of each label and third of ids, the greatest id first; each joins the nearest earlier leader or becomes one: a sequence, which SQL does not express."""
    e = table(spark, sf_dir, "embeddings").where("vec_id is not null").select(F.col("label").alias("ticker"), (F.col("vec_id") % 3).alias("day"), "vec_id", "embedding", F.concat(F.lit("no "), (F.col("vec_id") % 4).cast("string")).alias("title"))
    return leaders.leader_clusters(e, ["ticker", "day"], [F.desc("vec_id")], "vec_id", "embedding", "title", 0.2).select("ticker", "day", "vec_id", "leader", *r6("similarity"))


# Sessions: weekdays of orders on an exchange in New York; the last weekday of each month is a half day.
_CLOCK = """s AS (SELECT d AS date, month(d + CASE WHEN isodow(d) = 5 THEN 3 ELSE 1 END) <> month(d) AS half FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE isodow(o_orderdate) < 6)),
 z AS (SELECT *, ((date + TIME '09:30') AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS open_utc, ((date + CASE WHEN half THEN TIME '13:00' ELSE TIME '16:00' END) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS close_utc FROM s),
 sessions AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS session, lead(date) OVER (ORDER BY date) AS final_date, lead(close_utc) OVER (ORDER BY date) AS final_close_utc FROM z)"""


def _last_weekday(d):
    """Whether a weekday is the last of its month."""
    return F.month(F.date_add(d, F.when(F.weekday(d) == 4, 3).otherwise(1))) != F.month(d)


def _sessions(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date")).where(F.weekday("date") < 5).distinct()
    return written(clock.session_table(d, "America/New_York", half_days=_last_weekday(F.col("date"))), "sessions")


@register("session_clock", f"WITH {_CLOCK} SELECT date, session, half AS half_day, open_utc, close_utc, final_date, final_close_utc FROM sessions")
def session_clock(spark, sf_dir):
    return _sessions(spark, sf_dir).select("date", F.col("session").cast("long").alias("session"), "half_day", "open_utc", "close_utc", "final_date", "final_close_utc")


# Bars: an order's minute of the day by its key, its business date the order's date or, for some, the next day.
_BARS = """bars AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 17 = 0 AS INT) AS business_date, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 MINUTE * (o_orderkey * 7 % 1440) AS at_utc FROM orders)"""


@register(
    "session_phases",
    f"""WITH {_CLOCK}, {_BARS}, j AS (SELECT b.*, (at_utc AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS local, s.open_utc, s.close_utc FROM bars b LEFT JOIN sessions s ON s.date = business_date),
 k AS (SELECT j.*, hour(local) * 60 + minute(local) AS m, CAST(local AS DATE) = business_date AS same, coalesce(at_utc BETWEEN o.open_utc AND o.close_utc AND CAST(local AS DATE) <> business_date, false) AS conflict FROM j LEFT JOIN sessions o ON o.date = CAST(local AS DATE)),
 p AS (SELECT *, CASE WHEN open_utc IS NULL OR conflict THEN NULL WHEN same AND at_utc BETWEEN open_utc AND close_utc THEN 'regular' WHEN same AND m >= 240 AND m < 570 THEN 'premarket'
   WHEN same AND m > (SELECT CASE WHEN half THEN 780 ELSE 960 END FROM sessions q WHERE q.date = business_date) AND m < 1200 THEN 'after_hours' ELSE 'overnight' END AS phase FROM k)
 SELECT id, conflict, phase, phase || ':' || lpad(CAST(greatest(0, CASE phase WHEN 'regular' THEN date_diff('minute', open_utc, at_utc) WHEN 'premarket' THEN m - 240 WHEN 'after_hours' THEN date_diff('minute', close_utc, at_utc) ELSE m END // 30) AS VARCHAR), 4, '0') AS bucket,
 at_utc + INTERVAL 30 MINUTE + INTERVAL 15 SECOND AS available_utc FROM p""",
)
def session_phases(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    at = o["o_orderdate"].cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("o_orderkey") * 7 % 1440).cast("int"))
    bars = o.select(F.col("o_orderkey").alias("id"), F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 17 == 0).cast("int")).alias("business_date"), at.alias("at_utc"))
    p = clock.phased(bars, _sessions(spark, sf_dir), "America/New_York", "at_utc", "business_date", 30)
    return p.select("id", "conflict", "phase", "bucket", clock.bar_available(F.col("at_utc"), 30, 15).alias("available_utc"))


@register(
    "latest_available_daily",
    f"""WITH {_CLOCK}, d AS (SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS x FROM orders GROUP BY ALL), a AS (SELECT ticker, d.date, x, final_close_utc + INTERVAL 15 MINUTE AS available_utc FROM d JOIN sessions USING (date))
 SELECT ticker, arg_max(date, date) AS date, round(arg_max(x, date), 2) AS x, max(available_utc) AS available_utc FROM a WHERE available_utc <= TIMESTAMP '1997-03-31 21:14:59' GROUP BY ticker""",
)
def latest_available_daily(spark, sf_dir):
    d = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("ticker"), F.col("o_orderdate").cast("date").alias("date")).agg(F.sum("o_totalprice").alias("x"))
    a = clock.daily_available(d, _sessions(spark, sf_dir), "date", 15 * 60)
    got = clock.latest_available(a, ["ticker"], "date", F.lit("1997-03-31 21:14:59").cast("timestamp_ntz"))
    return got.select("ticker", "date", F.round("x", 2).alias("x"), "available_utc")
