"""Scores of forecasts and strategies as aggregates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .panel import average_rank, pearson
from .ranges import running_sums


def daily_ic(panel: DataFrame, pred: str, target: str, least: int = 3) -> DataFrame:
    """Pearson and rank correlation of each date, null under ``least`` rows or without spread."""
    some = panel.where(F.col(pred).isNotNull() & F.col(target).isNotNull())
    ranked = some.withColumns({"_rp": average_rank(pred), "_rt": average_rank(target)})
    ok = (F.count("*") >= least) & (F.stddev_pop(pred) > 1e-12) & (F.stddev_pop(target) > 1e-12)
    return ranked.groupBy("date").agg(F.count("*").alias("n"), F.when(ok, pearson(pred, target)).alias("ic"), F.when(ok, pearson("_rp", "_rt")).alias("rank_ic"))


def newey_west(series: DataFrame, x: str, order: str, lags: int, group: str = "series") -> DataFrame:
    """Mean and t-value of each group's series under Bartlett weights."""
    w = Window.partitionBy(group).orderBy(order)
    c = series.where(F.col(x).isNotNull()).withColumn("_c", F.col(x) - F.avg(x).over(Window.partitionBy(group)))
    c = c.withColumns({f"_p{k}": F.col("_c") * F.lag("_c", k).over(w) for k in range(1, lags + 1)})
    n = F.count("*")
    variance = F.sum(F.col("_c") * F.col("_c")) / n
    for k in range(1, lags + 1):
        variance = variance + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(f"_p{k}"), F.lit(0.0)) / n
    return c.groupBy(group).agg(n.alias("n"), F.avg(x).alias("mean"), (F.avg(x) / F.sqrt(F.when(variance > 0, variance) / n)).alias("t_value"))


def decile_spread(panel: DataFrame, pred: str, target: str, share: float = 0.1, least: int = 20) -> DataFrame:
    """Mean target of the top and of the bottom share of each date."""
    d = Window.partitionBy("date")
    some = panel.where(F.col(pred).isNotNull() & F.col(target).isNotNull()).withColumns(
        {"_n": F.count("*").over(d), "_up": F.row_number().over(d.orderBy(F.desc(pred), "ticker")), "_low": F.row_number().over(d.orderBy(F.asc(pred), "ticker"))}
    )
    k = F.greatest(F.lit(1), F.floor(F.col("_n") * share))
    got = some.where(F.col("_n") >= least).groupBy("date")
    return got.agg(F.avg(F.when(F.col("_up") <= k, F.col(target))).alias("top"), F.avg(F.when(F.col("_low") <= k, F.col(target))).alias("bottom")).withColumn("spread", F.col("top") - F.col("bottom"))


def _binary(scored: DataFrame, score: str, label: str, *more: str) -> DataFrame:
    """Rows with score and label, without rows that have no group: a missing group is one of its own."""
    return scored.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(F.col(score).alias("_s"), F.col(label).cast("long").alias("_y"), *more)


def roc_auc(scored: DataFrame, score: str, label: str, group: str) -> DataFrame:
    """Area under the curve by average ranks, for each group.

    Rows are counted by group and score first; a running sum over the distinct scores gives the ranks."""
    g = _binary(scored, score, label, group).groupBy(group, "_s").agg(F.count("*").alias("_n"), F.sum("_y").alias("_p"))
    r = running_sums(g.withColumn("_g", F.struct(group)), ["_g"], [F.col("_s")], {"_upto": "_n"})
    rank = F.col("_upto") - (F.col("_n") - 1) / 2
    pos, neg = F.sum("_p"), F.sum(F.col("_n") - F.col("_p"))
    return r.groupBy(group).agg(pos.alias("positives"), neg.alias("negatives"), F.try_divide(F.sum(F.col("_p") * rank) - pos * (pos + 1) / 2, (pos * neg).cast("double")).alias("auc"))


def _best_first(scored: DataFrame, score: str, label: str, key: str, group: str) -> DataFrame:
    """Rows with ``_i``, their place in the group by descending score and key, and ``_hits``, the positives up to them."""
    r = _binary(scored, score, label, group, key).withColumns({"_one": F.lit(1).cast("long"), "_g": F.struct(group)})
    return running_sums(r, ["_g"], [F.desc("_s"), F.desc(key)], {"_i": "_one", "_hits": "_y"})


def average_precision(scored: DataFrame, score: str, label: str, key: str, group: str) -> DataFrame:
    """Mean precision at each positive, best scores first; ties by descending key."""
    r = _best_first(scored, score, label, key, group)
    return r.groupBy(group).agg(F.avg(F.when(F.col("_y") == 1, F.col("_hits") / F.col("_i"))).alias("average_precision"))


def precision_at_rate(scored: DataFrame, score: str, label: str, key: str, group: str, rate: float) -> DataFrame:
    """Precision, recall and lift of the share ``rate`` of rows with the best scores."""
    r = _best_first(scored, score, label, key, group)
    sizes = r.groupBy("_g").agg(F.max("_i").alias("_n"))
    top = F.when(F.col("_i") <= F.ceil(F.col("_n") * rate), F.col("_y"))
    hit, base = F.avg(top.cast("double")), F.avg(F.col("_y").cast("double"))
    return r.join(sizes, "_g").groupBy(group).agg(hit.alias("precision"), F.try_divide(F.sum(top).cast("double"), F.sum("_y")).alias("recall"), F.try_divide(hit, base).alias("lift"))


def kappa(pairs: DataFrame, a: str, b: str, group: str) -> DataFrame:
    """Cohen's kappa of two raters, for each group, from the contingency table."""
    table = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(group, a, b).agg(F.count("*").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy(group))
    t = table.withColumns({"_t": total, "_ra": F.sum("_n").over(Window.partitionBy(group, a)), "_rb": F.sum("_n").over(Window.partitionBy(group, b))})
    # expected agreement needs the row and column sums of one category
    rows = t.groupBy(group, F.col(a).alias("_k")).agg(F.max("_ra").alias("_ra"), F.max("_t").alias("_t"))
    cols = t.groupBy(group, F.col(b).alias("_k")).agg(F.max("_rb").alias("_rb"))
    expected = rows.join(cols, [group, "_k"]).groupBy(group).agg(F.sum(F.col("_ra") / F.col("_t") * F.col("_rb") / F.col("_t")).alias("expected"))
    seen = t.groupBy(group).agg((F.sum(F.when(F.col(a) == F.col(b), F.col("_n")).otherwise(0)) / F.max("_t")).alias("agreement"), F.max("_t").alias("n"))
    return seen.join(expected, group).select(group, "n", "agreement", F.try_divide(F.col("agreement") - F.col("expected"), 1 - F.col("expected")).alias("kappa"))


def performance(returns: DataFrame, r: str, order: str, per_year: float, group: str = "strategy") -> DataFrame:
    """Total and yearly return, Sharpe ratio (sample deviation), deepest fall, mean of the worst 5 %, share of gains."""
    w = Window.partitionBy(group).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    e = returns.where(F.col(r).isNotNull()).withColumn("_e", F.exp(F.sum(F.log1p(r)).over(upto)))
    e = e.withColumns({"_peak": F.max("_e").over(upto), "_i": F.row_number().over(Window.partitionBy(group).orderBy(r, order)), "_n": F.count("*").over(Window.partitionBy(group))})
    total = F.exp(F.sum(F.log1p(r)))
    return e.groupBy(group).agg(
        F.count("*").alias("periods"),
        (total - 1).alias("total_return"),
        (F.pow(total, F.lit(per_year) / F.count("*")) - 1).alias("cagr"),
        F.try_divide(F.avg(r), F.stddev_samp(r)).alias("_s"),
        F.min(F.col("_e") / F.col("_peak") - 1).alias("max_drawdown"),
        F.avg(F.when(F.col("_i") <= F.greatest(F.lit(1), F.floor(F.col("_n") * 0.05)), F.col(r))).alias("cvar_5"),
        F.avg(F.when(F.col(r) > 0, 1.0).otherwise(0.0)).alias("hit_rate"),
    ).withColumn("sharpe", F.col("_s") * math.sqrt(per_year)).drop("_s")
