"""Selection policies and exits as windows over dates and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def top_k(panel: DataFrame, score: str, k: int, tie: str = "ticker") -> DataFrame:
    """The k best of each date, with ``pick`` from 1; ties by the smaller key."""
    w = Window.partitionBy("date").orderBy(F.desc(score), tie)
    return panel.where(F.col(score).isNotNull()).withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= k)


def liquid_then_best(panel: DataFrame, liquidity: str, n: int, score: str, k: int) -> DataFrame:
    """Of the n most liquid of each date (ties: larger key), the k best."""
    w = Window.partitionBy("date").orderBy(F.desc(liquidity), F.desc("ticker"))
    liquid = panel.where(F.col(liquidity).isNotNull()).withColumn("_l", F.row_number().over(w)).where(F.col("_l") <= n).drop("_l")
    return top_k(liquid, score, k)


def strided(panel: DataFrame, h: int) -> DataFrame:
    """Rows of every h-th date: periods that do not overlap. The panel is written once."""
    panel = written(panel, "panel")
    dates = panel.select("date").distinct().groupBy().agg(F.array_sort(F.collect_list("date")).alias("d"))
    kept = dates.select(F.posexplode("d").alias("i", "date")).where(F.col("i") % h == 0).select("date")
    return panel.join(F.broadcast(kept), "date")  # one row a session


def rank_backtest(panel: DataFrame, score: str, target: str, k: int, h: int, cost: float = 0.0) -> DataFrame:
    """Mean target of the k best against all, every h-th date; dates with fewer than k are left out."""
    some = strided(panel, h).where(F.col(score).isNotNull() & F.col(target).isNotNull())
    w = Window.partitionBy("date")
    r = some.withColumns({"_i": F.row_number().over(w.orderBy(F.desc(score), "ticker")), "_n": F.count("*").over(w)}).where(F.col("_n") >= k)
    return r.groupBy("date").agg(
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("_i") <= k, F.col("ticker")))), ",").alias("selected"),
        (F.avg(F.when(F.col("_i") <= k, F.col(target))) - cost).alias("period_return"),
        (F.avg(target) - cost).alias("benchmark_return"),
    )


def turnover(picks: DataFrame, k: int) -> DataFrame:
    """Share of each date's names that the date before did not hold; 1 at first."""
    held = picks.groupBy("date").agg(F.collect_set("ticker").alias("held"))
    w = Window.partitionBy(F.lit(1)).orderBy("date")  # one row a session
    return held.select("date", F.coalesce(1 - F.size(F.array_intersect("held", F.lag("held").over(w))) / k, F.lit(1.0)).alias("turnover"))


def stop_or_take(panel: DataFrame, stop: float, take: float, hold: int) -> DataFrame:
    """Return from the next open to the first close of the path that falls by ``stop`` or gains
    ``take`` (tested on closes), or to the last close of ``hold`` rows."""
    w = Window.partitionBy("ticker").orderBy("date")
    path = F.collect_list(F.struct("close")).over(w.rowsBetween(1, hold))
    p = panel.withColumns({"_entry": F.lead("open", 1).over(w), "_path": F.transform(path, lambda s: s["close"])})
    p = p.where((F.col("_entry") > 0) & (F.size("_path") == hold) & F.forall("_path", lambda c: c.isNotNull()))
    gains = F.transform("_path", lambda c: c / F.col("_entry") - 1)
    hit = F.transform(gains, lambda g: (g >= take) | (g <= -stop))
    day = F.coalesce(F.nullif(F.array_position(hit, True), F.lit(0).cast("long")), F.lit(hold).cast("long"))
    return p.withColumn("_day", day).select("ticker", "date", F.col("_day").alias("exit_day"), (F.element_at("_path", F.col("_day").cast("int")) / F.col("_entry") - 1).alias("exit_return"))


def rank_exit(panel: DataFrame, score: str, k: int, keep: int, cap: int) -> DataFrame:
    """Entries are the k best of a date. A position ends on the first day from the second on at whose eve the latest
    scores, of that day or an earlier one, do not have the name among the ``keep`` best (names without a score are not), ``cap``
    days after entry at most. Before the first scores it is held. The panel is written once, for ranks, sessions and paths."""
    panel = written(panel.select("ticker", "date", "open", "execution_close", score), "panel")
    w = Window.partitionBy("date").orderBy(F.desc(score), "ticker")
    ranked = panel.where(F.col(score).isNotNull()).withColumn("_i", F.row_number().over(w)).select("ticker", F.col("date").alias("_signal"), "_i")
    # one row a session: the latest session with scores
    days = panel.groupBy("date").agg(F.count(score).alias("_n"))
    latest = F.last(F.when(F.col("_n") > 0, F.col("date")), ignorenulls=True).over(Window.partitionBy(F.lit(1)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    e = panel.join(F.broadcast(days.select("date", latest.alias("_signal"))), "date").join(ranked, ["ticker", "_signal"], "left")
    own = Window.partitionBy("ticker").orderBy("date")
    gone = F.collect_list(F.col("_signal").isNotNull() & F.coalesce(F.col("_i") > keep, F.lit(True))).over(own.rowsBetween(1, cap - 1))
    path = F.collect_list(F.struct("execution_close")).over(own.rowsBetween(1, cap))
    e = e.withColumns({"_entry": F.lead("open", 1).over(own), "_out": gone, "_path": path})
    e = e.where((F.col("_signal") == F.col("date")) & (F.col("_i") <= k) & (F.col("_entry") > 0) & (F.size("_path") == cap))
    pos = F.array_position("_out", True)
    day = F.when(pos > 0, pos + 1).otherwise(F.lit(cap).cast("long"))
    at = F.element_at("_path", F.col("_d").cast("int"))["execution_close"]
    return e.withColumn("_d", day).select("ticker", "date", F.col("_d").alias("exit_day"), (at / F.col("_entry") - 1).alias("exit_return"))


def ladder_exit(panel: DataFrame, legs: list[int]) -> DataFrame:
    """Mean return of equal parts sold ``legs`` rows after entry at the next open."""
    w = Window.partitionBy("ticker").orderBy("date")
    entry = F.lead("open", 1).over(w)
    parts = [F.lead("close", n).over(w) / entry - 1 for n in legs]
    return panel.withColumn("ladder_return", F.when(entry > 0, sum(parts[1:], parts[0]) / len(parts))).where("ladder_return is not null").select("ticker", "date", "ladder_return")


def scale_in(panel: DataFrame, drop: float, window: int, hold: int) -> DataFrame:
    """A second equal leg at the first close ``drop`` below the entry within ``window`` rows;
    the return of both legs at the close of ``hold`` rows, in units of the first leg."""
    w = Window.partitionBy("ticker").orderBy("date")
    p = panel.withColumns({"_entry": F.lead("open", 1).over(w), "_path": F.transform(F.collect_list(F.struct("execution_close")).over(w.rowsBetween(1, hold)), lambda s: s["execution_close"])})
    p = p.where((F.col("_entry") > 0) & (F.size("_path") == hold))
    low = F.transform(F.slice("_path", 1, window), lambda c: c <= F.col("_entry") * (1 - drop))
    day = F.array_position(low, True)
    last = F.element_at("_path", hold)
    add = F.when(day > 0, last / F.element_at("_path", F.greatest(day, F.lit(1)).cast("int")) - 1).otherwise(0.0)
    return p.select("ticker", "date", day.alias("add_day"), (last / F.col("_entry") - 1 + add).alias("leg_return"), F.when(day > 0, 2).otherwise(1).alias("capital"))
