"""Sums that can be merged: forecast metrics and least squares by group, as partial and final aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import finite

STATE = ("count", "absolute_error", "squared_error", "target_squared", "prediction", "target", "prediction_squared", "cross", "direction_count", "direction_correct")


def forecast_state(rows: DataFrame, keys: list[str], prediction: str, target: str, selected: Column | None = None) -> DataFrame:
    """One row of sums a key, over pairs that are both finite and selected. Sums of different rows of one key may be added by ``merged_state``."""
    p, t = finite(F.col(prediction).cast("double")), finite(F.col(target).cast("double"))
    some = rows.select(*keys, p.alias("_p"), t.alias("_t"), (F.lit(True) if selected is None else F.coalesce(selected, F.lit(False))).alias("_s"))
    some = some.where("_p is not null and _t is not null and _s")
    p, t = F.col("_p"), F.col("_t")
    return some.groupBy(*keys).agg(
        F.count("*").alias("count"), F.sum(F.abs(p - t)).alias("absolute_error"), F.sum((p - t) ** 2).alias("squared_error"), F.sum(t * t).alias("target_squared"), F.sum(p).alias("prediction"), F.sum(t).alias("target"),
        F.sum(p * p).alias("prediction_squared"), F.sum(p * t).alias("cross"), F.count_if(t != 0).alias("direction_count"), F.count_if((t != 0) & (F.signum(p) == F.signum(t))).alias("direction_correct"),
    )


def merged_state(states: DataFrame, keys: list[str]) -> DataFrame:
    """States of parts as those of the whole."""
    return states.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in STATE])


def forecast_metrics(states: DataFrame, keys: list[str]) -> DataFrame:
    """count, mae, mse, pearson, skill_vs_zero_mse and direction_accuracy of each state; null under three pairs."""
    c, n = F.col, F.col("count").cast("double")
    pv, tv = c("prediction_squared") - c("prediction") ** 2 / n, c("target_squared") - c("target") ** 2 / n
    r = (c("cross") - c("prediction") * c("target") / n) / F.sqrt(pv * tv)
    enough = c("count") >= 3
    values = {
        "mae": c("absolute_error") / n,
        "mse": c("squared_error") / n,
        "pearson": F.when((pv > n * 1e-24) & (tv > n * 1e-24), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0))),
        "skill_vs_zero_mse": F.when(c("target_squared") > 1e-12, 1 - c("squared_error") / c("target_squared")),
        "direction_accuracy": F.try_divide(c("direction_correct"), c("direction_count")),
    }
    return states.select(*keys, "count", *[F.when(enough, v).alias(k) for k, v in values.items()])


def normal_state(rows: DataFrame, keys: list[str], xs: list[str], y: str) -> DataFrame:
    """n, the sums of products of (1, x1, .., xk) with each other and with y, and of y squared: the normal equations of each key, ready to be added."""
    whole = rows.where(" and ".join(f"{c} is not null" for c in [*xs, y]))
    terms = [F.lit(1.0), *[F.col(x) for x in xs]]
    xx = [F.sum(a * b) for i, a in enumerate(terms) for b in terms[i:]]
    return whole.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*xx).alias("xx"), F.array(*[F.sum(t * F.col(y)) for t in terms]).alias("xy"), F.sum(F.col(y) ** 2).alias("yy"))


def merged_normal(states: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Normal equations of parts as those of the whole; k: the number of regressors."""
    each = lambda c, m: F.array(*[F.sum(F.col(c)[i]) for i in range(m)]).alias(c)
    return states.groupBy(*keys).agg(F.sum("n").alias("n"), each("xx", (k + 1) * (k + 2) // 2), each("xy", k + 1), F.sum("yy").alias("yy"))


def solved(states: DataFrame, keys: list[str], k: int, ridge: float = 0.0) -> DataFrame:
    """n, coefficients (intercept first) and r2 of each key's equations; null where they are singular or have no more rows than coefficients.

    ridge is added to the diagonal but for the intercept's. Every key is solved by itself, many at a time in numpy."""
    m = k + 1
    schema = ", ".join([*[f"{c} {states.schema[c].dataType.simpleString()}" for c in keys], "n long, coefficients array<double>, r2 double"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up = np.triu_indices(m)
        for pdf in frames:
            if not len(pdf):
                continue
            a = np.zeros((len(pdf), m, m))
            a[:, up[0], up[1]] = a[:, up[1], up[0]] = np.array(pdf["xx"].tolist())
            b, yy, n = np.array(pdf["xy"].tolist()), pdf["yy"].to_numpy(float), pdf["n"].to_numpy()
            total = yy - b[:, 0] ** 2 / np.maximum(n, 1)
            a[:, range(1, m), range(1, m)] += ridge
            # scaled to a unit diagonal, so that the rank does not hang on units
            d = np.sqrt(np.maximum(np.einsum("nii->ni", a), 1e-300))
            ok = (n > m) & (np.linalg.matrix_rank(a / d[:, :, None] / d[:, None, :], tol=1e-10) == m)
            coef = np.full((len(pdf), m), np.nan)
            coef[ok] = np.linalg.solve(a[ok], b[ok][:, :, None])[:, :, 0]
            left = yy - (coef * b).sum(axis=1)
            r2 = np.where(ok & (total > 1e-12), 1 - left / np.where(total > 1e-12, total, 1), np.nan)
            out = pdf[[*keys, "n"]].copy()
            out["coefficients"] = [c.tolist() if o else None for c, o in zip(coef, ok, strict=True)]
            out["r2"] = [None if x != x else float(x) for x in r2]
            yield out

    return states.select(*keys, "n", "xx", "xy", "yy").mapInPandas(run, schema)


def placebo(rows: DataFrame, split: list[str], key: list[str], x: str, seed: int, block: int = 4096) -> DataFrame:
    """rows with ``placebo``: the values of x exchanged among the rows of a split by a seeded permutation; ``key`` names a row.

    Rows are dealt to blocks of about ``block`` by a hash of seed and key, and the values of a block are exchanged between its rows, so that no task
    holds a split. A block draws its rows from all of the split."""
    h = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), *[F.col(c) for c in key])
    sizes = rows.groupBy(*split).agg(F.greatest(F.lit(1), F.round(F.count("*") / block)).cast("long").alias("_blocks"))
    dealt = rows.join(sizes, split).withColumn("_b", F.pmod(h("block"), F.col("_blocks")))
    w = Window.partitionBy(*split, "_b")
    own = dealt.withColumns({"_to": F.row_number().over(w.orderBy(*key)), "_from": F.row_number().over(w.orderBy(h("order"), *key))}).drop("_blocks")
    given = own.select(*split, "_b", F.col("_from").alias("_to"), F.col(x).alias("placebo"))
    return own.drop("_from").join(given, [*split, "_b", "_to"]).drop("_b", "_to")


