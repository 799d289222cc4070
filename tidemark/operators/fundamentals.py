"""Filings and other sparse series: quarters, growth, surprises, runs, lifecycles, factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import ratio


def discrete_quarters(filings: DataFrame, entity: str, x: str) -> DataFrame:
    """Values by quarter from rows (entity, year, quarter, x) where quarter 4 holds the year:
    its own part is the year less the first three quarters, null unless all three are there."""
    w = Window.partitionBy(entity, "year")
    early = F.sum(F.when(F.col("quarter") < 4, F.col(x))).over(w)
    n = F.count(F.when(F.col("quarter") < 4, F.col(x))).over(w)
    return filings.withColumn("discrete", F.when(F.col("quarter") < 4, F.col(x)).when(n == 3, F.col(x) - early))


def year_on_year(q: DataFrame, entity: str, x: str) -> DataFrame:
    """x with its change against the same quarter of the year before."""
    before = q.select(F.col(entity), (F.col("year") + 1).alias("year"), "quarter", F.col(x).alias("_before"))
    return q.join(before, [entity, "year", "quarter"], "left").withColumn("yoy", ratio(F.col(x), F.abs("_before")) - F.signum("_before")).drop("_before")


def standard_surprise(q: DataFrame, entity: str, order: list[str], x: str, least: int = 4, limit: float = 10.0) -> DataFrame:
    """Change against four rows before, over the population deviation of the changes known before it."""
    w = Window.partitionBy(entity).orderBy(*order)
    d = q.withColumn("_d", F.col(x) - F.lag(x, 4).over(w))
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    s = F.when((F.count("_d").over(past) >= least) & (F.stddev_pop("_d").over(past) > 1e-12), F.col("_d") / F.stddev_pop("_d").over(past))
    # least and greatest skip nulls, so that an unknown surprise has to stay out of them
    return d.withColumn("_s", s).withColumn("surprise", F.when(F.col("_s").isNotNull(), F.greatest(F.least(F.col("_s"), F.lit(limit)), F.lit(-limit)))).drop("_d", "_s")


def days_since_change(series: DataFrame, key: str, order: str, x: str) -> DataFrame:
    """Rows since x last took another value: 0 on the row of the change."""
    w = Window.partitionBy(key).orderBy(order)
    new = F.when(F.col(x).eqNullSafe(F.lag(x).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    run = series.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.withColumn("since", (F.row_number().over(Window.partitionBy(key, "_run").orderBy(order)) - 1).cast("long")).drop("_new", "_run")


def merged_intervals(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Overlapping or touching spans of a key as one."""
    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    m = spans.withColumn("_new", F.coalesce(F.col(start) > reach, F.lit(True)).cast("int")).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return m.groupBy(key, "_g").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("parts")).drop("_g")


def latest_listing(catalog: DataFrame, key: str, listed: str, delisted: str, as_of: Column, keep: Column, ties: list[str]) -> DataFrame:
    """Of each key the last listing that is active on a date and passes ``keep``; those of equal dates go by ``ties``, ascending, null last."""
    active = catalog.where((F.col(listed) <= as_of) & (F.col(delisted).isNull() | (F.col(delisted) >= as_of)) & keep)
    w = Window.partitionBy(key).orderBy(F.desc(listed), F.desc_nulls_first(delisted), *map(F.asc_nulls_last, ties))
    return active.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def factor_jumps(panel: DataFrame, key: str, order: str, factor: str, least: float = 0.02) -> DataFrame:
    """Rows whose factor moved by ``least`` against the row before."""
    before = F.lag(factor).over(Window.partitionBy(key).orderBy(order))
    return panel.withColumn("factor_before", before).where(F.abs(ratio(F.col(factor), F.col("factor_before")) - 1) >= least)


def ensemble(predictions: DataFrame, keys: list[str], seed: str, x: str, n: int) -> DataFrame:
    """Mean of x over the seeds, for keys that all n seeds hold."""
    g = predictions.groupBy(*keys).agg(F.avg(x).alias("mean"), F.count_distinct(seed).alias("seeds"))
    return g.where(F.col("seeds") == n)


def compounded(rates: DataFrame, day: str, rate: str, h: int) -> DataFrame:
    """Growth of a yearly rate in per cent over the next h calendar days, null unless all are known.

    One row a day: the window runs over the calendar alone."""
    w = Window.partitionBy(F.lit(1)).orderBy(day).rowsBetween(1, h)
    whole = (F.count(rate).over(w) == h) & (F.datediff(F.max(day).over(w), F.col(day)) == h)
    return rates.withColumn("growth", F.when(whole, F.exp(F.sum(F.log1p(F.col(rate) / 100) / 365).over(w)) - 1))
