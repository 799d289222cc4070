"""Daily frames of market events: one row an entity and session, and the entities' exposure to themes.

Events are rows of (seq, ticker, event_id, event_date, effective_session, relevance, specificity, quality, polarity, magnitude, confidence,
score_contribution, node_deltas, edge_deltas, raw_themes, themes, affected_nodes, event_type); a null is an absent value. node_deltas are
structs (node, delta, confidence), edge_deltas structs (src, dst, edge_type, delta_weight, confidence), the theme columns arrays of text.
seq is the order in which events were read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from . import gram
from .events import least_decay, with_decay
from .panel import finite, ratio

NAMES = ("news_score_1d", "news_score_decay", "news_abs_decay", "news_count_decay", "news_count_3d", "news_count_10d", "news_pos_3d", "news_neg_3d", "news_confidence_1d")


def unit(x: Column) -> Column:
    """x within 0..1; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def is_relevant(relevance: Column, specificity: Column) -> Column:
    """Without a relevance an event passes; else it needs a finite one of 0.5, and the same of its specificity if it has one."""
    enough = lambda x: F.coalesce(finite(x) >= 0.5, F.lit(False))
    return relevance.isNull() | (enough(relevance) & (specificity.isNull() | enough(specificity)))


def evidence_mass(*parts: Column) -> Column:
    """Product of the parts within 0..1; an absent part counts as 1, and one that is not finite makes the mass 0."""
    out = F.lit(1.0)
    for p in parts:
        out = out * F.when(p.isNull(), 1.0).otherwise(F.coalesce(unit(finite(p)), F.lit(0.0)))
    return out


def scored(events: DataFrame) -> DataFrame:
    """events with score, pos, neg, magnitude_sum and confidence_mean.

    The score is the sum of delta * confidence over the entity's own deltas, or polarity * magnitude * confidence where it has none;
    a given contribution replaces it. Magnitudes never fall below the score's."""
    c = F.col
    own = F.transform(
        F.filter(F.coalesce("node_deltas", F.array().cast("array<struct<node:string,delta:double,confidence:double>>")), lambda d: d["node"].cast("string") == c("ticker").cast("string")),
        lambda d: F.struct(F.coalesce(d["confidence"], c("confidence"), F.lit(1.0)).alias("w"), F.coalesce(d["delta"], F.lit(0.0)).alias("d")),
    )
    total = lambda f: F.aggregate(own, F.lit(0.0), lambda s, d: s + f(d))
    has = F.size(own) > 0
    alone = F.coalesce("polarity", F.lit(0.0)) * F.coalesce("magnitude", F.lit(0.0)) * F.coalesce("confidence", F.lit(0.0))
    first = F.when(has, total(lambda d: d["d"] * d["w"])).otherwise(alone)
    sure = F.when(has, total(lambda d: unit(d["w"])) / F.size(own)).otherwise(unit(F.coalesce("confidence", F.lit(0.0))))
    e = events.withColumns({"_first": first, "_abs": F.when(has, total(lambda d: F.abs(d["d"] * d["w"]))).otherwise(F.abs(alone)), "confidence_mean": sure})
    e = e.withColumn("score", F.coalesce("score_contribution", "_first"))
    pos, neg = F.greatest(F.lit(0.0), c("score")), F.greatest(F.lit(0.0), -c("score"))
    return e.withColumns({"pos": pos, "neg": neg, "magnitude_sum": F.greatest(c("_abs"), F.abs(c("score")))}).drop("_first", "_abs")


def _clean(x: Column) -> Column:
    """A theme: white space as one space, lower case, 48 characters; what holds an entity's code of six digits is none."""
    t = F.lower(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " ")))
    return F.when(t.rlike(r"[0-9]{6}"), "").otherwise(F.substring(t, 1, 48))


def themes_of(events: DataFrame) -> Column:
    """Distinct themes of an event, in the order edges, raw themes, themes, nodes, type."""
    none = F.array().cast("array<string>")
    edges = F.filter(F.coalesce("edge_deltas", F.array().cast(events.schema["edge_deltas"].dataType)), lambda d: (d["dst"].cast("string") == F.col("ticker").cast("string")) | (F.lower(d["edge_type"]) == "theme_exposure"))
    kind = _clean(F.col("event_type"))
    lists = [F.transform(edges, lambda d: _clean(d["src"])), *[F.transform(F.coalesce(c, none), _clean) for c in ("raw_themes", "themes", "affected_nodes")], F.when((kind != "") & (kind != "unknown"), F.array(F.concat(F.lit("event:"), kind))).otherwise(none)]
    return F.filter(F.array_distinct(F.concat(*lists)), lambda t: t != "")


def theme_strength(events: DataFrame) -> Column:
    """The largest |weight| * confidence of the entity's own edges, or magnitude * confidence without any; never 0, 2 at most."""
    c = F.col
    own = F.filter(F.coalesce("edge_deltas", F.array().cast(events.schema["edge_deltas"].dataType)), lambda d: d["dst"].cast("string") == c("ticker").cast("string"))
    edge = F.array_max(F.transform(own, lambda d: F.abs(F.coalesce(d["delta_weight"], F.lit(0.0))) * unit(F.coalesce(d["confidence"], c("confidence_mean")))))
    s = F.coalesce(edge, c("magnitude_sum") * unit(c("confidence_mean")))
    return F.least(F.lit(2.0), F.when(s > 0, s).otherwise(F.greatest(c("magnitude_sum"), 0.05 * c("mass"))))


def on_sessions(events: DataFrame, sessions: DataFrame, lag: int = 1) -> DataFrame:
    """events with ``t``, the place of their session: the first at or after their effective session, or ``lag`` after the first at or
    after their date; without those that fall beyond the calendar. sessions: one row a date; days are looked up, not events."""
    at = F.coalesce(F.col("effective_session").cast("date"), F.col("event_date").cast("date"))
    days = events.select(at.alias("date")).where("date is not null").distinct()
    both = days.withColumn("_s", F.lit(0)).unionByName(sessions.select(F.col("date").cast("date").alias("date"), F.lit(1).alias("_s")).distinct())
    # of one date the day comes first, so that it counts the sessions before it; one row a day
    place = F.sum("_s").over(Window.orderBy("date", "_s").rowsBetween(Window.unboundedPreceding, 0))
    known = both.withColumn("_t", place).where("_s = 0").select(F.col("date").alias("_day"), "_t")
    last = sessions.select("date").distinct().agg(F.count("*").alias("_n"))
    j = events.withColumn("_day", at).join(F.broadcast(known), "_day").join(F.broadcast(last), F.lit(True))
    return j.withColumn("t", F.col("_t") + F.when(F.col("effective_session").isNull(), lag).otherwise(0)).where("t < _n").drop("_day", "_t", "_n")


def accepted(events: DataFrame, sessions: DataFrame, lag: int = 1) -> DataFrame:
    """Relevant events on a session with evidence, the first of each entity and id, with mass, t and scores. Events without id all stay."""
    e = events.where(is_relevant(F.col("relevance"), F.col("specificity"))).withColumn("mass", evidence_mass(F.col("relevance"), F.col("specificity"), F.col("quality"))).where("mass > 0")
    e = on_sessions(e, sessions, lag)
    named = F.trim(F.coalesce(F.col("event_id").cast("string"), F.lit("")))
    w = Window.partitionBy("ticker", F.when(named == "", F.concat(F.lit("\0"), F.col("seq").cast("string"))).otherwise(named)).orderBy("seq")
    return scored(e.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i"))


def bounded(x: str, count: str, low: float) -> Column:
    """A day's sum over the root of its evidence, within low..1, so that many events raise counts and not intensities."""
    return F.greatest(F.lit(low), F.least(F.lit(1.0), F.col(x) / F.sqrt(F.greatest(F.col(count), F.lit(1.0)))))


def event_frames(entities: DataFrame, sessions: DataFrame, events: DataFrame, half_life: float = 5.0, lag: int = 1, horizon: float = 60.0, digits: int | None = 8) -> DataFrame:
    """ticker, date and the nine NAMES: one row for every entity (ticker) and session (date). digits: places that logarithms of counts are rounded to (half to even)."""
    e = accepted(events, sessions, lag)
    sums = {"score": "score", "count": "mass", "pos": "pos", "neg": "neg", "abs": "magnitude_sum", "conf": "confidence_mean"}
    daily = e.groupBy("ticker", "t").agg(*[F.sum(x).alias(k) for k, x in sums.items()])
    calendar = sessions.select("date").distinct().agg(F.array_sort(F.collect_list("date")).alias("_dates"))  # one row, one entry a session
    grid = entities.select("ticker").distinct().join(F.broadcast(calendar), F.lit(True)).select("ticker", F.posexplode("_dates").alias("t", "date"))
    j = grid.join(daily, ["ticker", "t"], "left").fillna(0.0, list(sums))
    j = j.withColumns({"score": bounded("score", "count", -1.0), "pos": bounded("pos", "count", 0.0), "neg": bounded("neg", "count", 0.0), "abs": bounded("abs", "count", 0.0)})
    d = with_decay(j, ["ticker"], "t", {"score": "_score", "abs": "_abs", "count": "_count"}, half_life)
    tiny = least_decay(half_life, horizon)
    w = Window.partitionBy("ticker").orderBy("t")
    cut = lambda x: F.when(F.abs(x) < tiny, 0.0).otherwise(F.col(x))
    over = lambda x, n: F.sum(x).over(w.rowsBetween(-(n - 1), 0))
    log = F.log1p(cut("_count"))
    values = [F.col("score"), cut("_score"), cut("_abs"), log if digits is None else F.bround(log, digits), over("count", 3), over("count", 10), over("pos", 3), over("neg", 3), F.coalesce(ratio(F.col("conf"), F.col("count")), F.lit(0.0))]
    return d.select("ticker", "date", *[v.alias(n) for n, v in zip(NAMES, values, strict=True)])


def theme_vocabulary(prepared: DataFrame, most: int = 96, least: float = 2.0) -> DataFrame:
    """(theme, mass, place): the ``most`` themes of greatest evidence, ``least`` at least; ties by the first event that names them."""
    each = prepared.select("seq", "mass", F.posexplode("all_themes").alias("i", "theme"))
    g = each.groupBy("theme").agg(F.sum("mass").alias("mass"), F.min(F.struct("seq", "i")).alias("first"))
    top = g.where(F.col("mass") >= least).orderBy(F.desc("mass"), "first").limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mass"), "first")) - 1).select("theme", "mass", "place")  # ``most`` rows


def daily_exposure(sessions: DataFrame, events: DataFrame, lag: int = 1, most: int = 96, least: float = 2.0) -> DataFrame:
    """(ticker, t, theme, x): each event's strength, shared by its themes of the vocabulary over the root of their number."""
    e = accepted(events, sessions, lag)
    prepared = written(e.select("seq", "ticker", "t", "mass", themes_of(e).alias("all_themes"), theme_strength(e).alias("strength")).where(F.size("all_themes") > 0), "themes")
    words = theme_vocabulary(prepared, most, least).agg(F.collect_list("theme").alias("_words"))  # one row of ``most`` themes
    known = prepared.join(F.broadcast(words), F.lit(True)).withColumn("known", F.array_intersect("all_themes", "_words")).where(F.size("known") > 0)
    each = known.select("ticker", "t", F.explode("known").alias("theme"), (F.col("strength") / F.sqrt(F.size("known").cast("double"))).alias("x"))
    return each.groupBy("ticker", "t", "theme").agg(F.sum("x").alias("x"))


def theme_exposure(sessions: DataFrame, events: DataFrame, half_life: float = 5.0, lag: int = 1, horizon: float = 60.0, most: int = 96, least: float = 2.0) -> DataFrame:
    """(ticker, date, theme, exposure): decayed exposures where they are not 0, from an entity's first event of the theme on."""
    daily = written(daily_exposure(sessions, events, lag, most, least), "exposure")
    calendar = sessions.select("date").distinct().agg(F.array_sort(F.collect_list("date")).alias("_dates"))
    since = daily.groupBy("ticker", "theme").agg(F.min("t").cast("int").alias("_a")).join(F.broadcast(calendar), F.lit(True))
    grid = since.select("ticker", "theme", "_dates", F.explode(F.sequence("_a", F.size("_dates") - 1)).alias("t")).select("ticker", "theme", "t", F.element_at("_dates", F.col("t") + 1).alias("date"))
    d = with_decay(grid.join(daily, ["ticker", "theme", "t"], "left"), ["ticker", "theme"], "t", {"x": "exposure"}, half_life, lanes=half_life in (1, 2, 3, 4, 5, 6, 7, 8))
    return d.where(F.col("exposure") >= least_decay(half_life, horizon)).select("ticker", "date", "theme", "exposure")


def theme_edges(exposure: DataFrame, vocabulary: DataFrame, top: int = 4, least: float = 0.05, scale: float = 0.25) -> DataFrame:
    """(src, dst, weight): of each entity the ``top`` others of most alike exposure (cosine) on one session; ties: larger dst.

    exposure: rows (ticker, theme, exposure) of the session; vectors run over the vocabulary's places, so that nodes meet in blocks."""
    size = vocabulary.count()
    pairs = exposure.join(F.broadcast(vocabulary.select("theme", "place")), "theme").where("exposure != 0")
    v = pairs.groupBy(F.col("ticker").alias("node")).agg(F.map_from_entries(F.collect_list(F.struct("place", "exposure"))).alias("m"))
    v = v.withColumn("v", F.transform(F.sequence(F.lit(0), F.lit(max(size, 1) - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b))
    v = v.withColumn("_n", norm).where("_n > 1e-8").select("node", F.transform("v", lambda x: x / F.col("_n")).alias("v"))
    return gram.strongest_products(v, None, top, least, "positive", scale, quantum=1e-9)  # ties are ties whatever the order of summing

