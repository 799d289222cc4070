"""Features of event streams: decay, distinct actives, causal baselines and tails."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import prior_rows


def with_decay(df: DataFrame, keys: list[str], t: str, columns: dict[str, str], half_life: float, lanes: bool = False) -> DataFrame:
    """df with d_t = x_t + a d_(t-1) under the name given for each x; t counts a key's rows without gaps.

    The recursion in closed form, the sum of x_s / a**s up to t, times a**t, over stretches of 500 half-lives, so that no power overflows;
    a stretch takes over the end of the one before. What lies two stretches back has lost 500 half-lives and is below a double's precision.

    lanes: for a half-life of few whole rows, one sum for each place within it, so that x is scaled by powers of two alone: a value is x itself in its
    row, exactly half of it a half-life later, and rounds as x * 0.5**(age / half_life) does."""
    size = max(1, int(500 * half_life))
    place = F.col(t) % size
    grown = F.pow(F.lit(2.0), place / half_life)
    inside = Window.partitionBy(*keys, "_stretch").orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(t).rowsBetween(Window.unboundedPreceding, -1)

    def within(x: str) -> Column:
        if not lanes:
            return F.sum(F.coalesce(x, F.lit(0.0)) * grown).over(inside) / grown
        h = int(half_life)
        out = F.lit(0.0)
        for lane in range(h):
            age = place - lane
            held = F.sum(F.when(F.pmod(age, F.lit(h)) == 0, F.coalesce(x, F.lit(0.0)) * F.pow(F.lit(2.0), age / h)).otherwise(0.0)).over(inside)
            lost = F.element_at(F.array(*[F.lit(0.5 ** (r / h)) for r in range(h)]), (F.pmod(age, F.lit(h)) + 1).cast("int"))
            out = out + held / F.pow(F.lit(2.0), F.floor(age / h)) * lost
        return out

    own = df.withColumn("_stretch", F.floor(F.col(t) / size)).withColumns({f"_{y}": within(x) for x, y in columns.items()})
    carried = {y: F.col(f"_{y}") + F.coalesce(F.last(F.when(place == size - 1, F.col(f"_{y}")), ignorenulls=True).over(before), F.lit(0.0)) / F.pow(F.lit(2.0), (place + 1) / half_life) for y in columns.values()}
    return own.withColumns(carried).drop("_stretch", *[f"_{y}" for y in columns.values()])


def least_decay(half_life: float, horizon: float, floor: float = 1e-3) -> float:
    """Decayed values below this count as 0."""
    return 0.5 ** (horizon / half_life) * floor


def decayed(daily: DataFrame, key: str, date: str, x: str, half_life: float, floor: float = 1e-3, horizon: float = 60.0) -> DataFrame:
    """d_t = x_t + a d_(t-1) for every key along all sessions of the calendar; small values become 0 after the recursion."""
    sessions = daily.agg(F.array_sort(F.collect_set(date)).alias("_dates"))  # one row, one entry a session
    grid = daily.select(key).distinct().join(F.broadcast(sessions), F.lit(True)).select(key, F.posexplode("_dates").alias("_t", date))
    j = with_decay(grid.join(daily, [key, date], "left"), [key], "_t", {x: "decay"}, half_life)
    return j.withColumn("decay", F.when(F.abs("decay") < least_decay(half_life, horizon, floor), 0.0).otherwise(F.col("decay"))).drop("_t")


def moving_level(df: DataFrame, keys: list[str], order: str, x: str, alpha: float) -> DataFrame:
    """``level``: the exponential average of a key's values by ``order``; the first value begins it, each later one moves it by alpha. Rows without x are left out.

    The recursion is a decay by 1 - alpha of the first value and of alpha times the others."""
    w = Window.partitionBy(*keys).orderBy(order)
    r = df.where(F.col(x).isNotNull()).withColumn("_t", F.row_number().over(w) - 1)
    r = r.withColumn("_v", F.when(F.col("_t") == 0, F.col(x).cast("double")).otherwise(alpha * F.col(x)))
    if alpha >= 1:
        return r.withColumn("level", F.col(x).cast("double")).drop("_t", "_v")
    return with_decay(r, keys, "_t", {"_v": "level"}, math.log(0.5) / math.log(1 - alpha)).drop("_t", "_v")


def rolling_actives(events: DataFrame, session: Column, member: str, spans: list[int]) -> DataFrame:
    """Distinct members over the last n sessions of the calendar, for each n.

    A member is counted in a span of sessions by its latest activity, so each pair of session
    and member is read once: it is active for span n on the sessions until its next activity,
    n sessions on at most."""
    days = events.select(session.alias("date"), F.col(member).alias("m")).distinct()
    calendar = days.select("date").distinct().groupBy().agg(F.array_sort(F.collect_list("date")).alias("d")).select(F.posexplode("d").alias("i", "date"))
    calendar = F.broadcast(calendar)  # one row a session
    at = days.join(calendar, "date").select("m", "i")
    nxt = F.lead("i").over(Window.partitionBy("m").orderBy("i"))
    last = at.withColumn("nxt", nxt)
    top = max(spans)
    spread = last.select("m", "i", F.explode(F.sequence(F.col("i"), F.least(F.col("i") + top - 1, F.coalesce(F.col("nxt") - 1, F.col("i") + top - 1)))).alias("on"))
    counts = spread.groupBy("on").agg(*[F.count(F.when(F.col("on") - F.col("i") < n, 1)).alias(f"active_{n}") for n in spans])
    return calendar.join(counts, calendar["i"] == counts["on"]).select("date", *[f"active_{n}" for n in spans])


def causal_median(df: DataFrame, keys: list[str], order: str, x: str, n: int, least: int) -> DataFrame:
    """``baseline``: the median of the n earlier rows of the same keys, with ``least`` values at least."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-n, -1)
    return df.withColumn("baseline", F.when(F.count(x).over(w) >= least, F.percentile(x, 0.5).over(w)))


def causal_tail(df: DataFrame, key: str, order: str, x: str, n: int, q: float, least: int) -> DataFrame:
    """``tail``: the q-quantile (the higher neighbour) of the n earlier values of the key."""
    v = df.where(F.col(x).isNotNull()).withColumn("_h", F.array_sort(F.collect_list(x).over(prior_rows(n, key, order))))
    at = (F.ceil((F.size("_h") - 1) * F.lit(q)) + 1).cast("int")
    return v.withColumn("tail", F.when(F.size("_h") >= least, F.element_at("_h", F.greatest(at, F.lit(1))))).drop("_h")
