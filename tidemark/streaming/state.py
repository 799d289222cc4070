"""Streaming operators: seen-set deduplication, windows, and matured-forecast state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_seen(stream: DataFrame, key: list[str], at: str, delay: str = "1 day") -> DataFrame:
    """Each key once; keys are remembered while the watermark allows late copies."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(key)


def tumbling_counts(stream: DataFrame, at: str, width: str, key: str, delay: str = "10 minutes") -> DataFrame:
    """Events and their sum of ``value`` by window and key."""
    g = stream.withWatermark(at, delay).groupBy(F.window(at, width).alias("w"), key)
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")


def ewma(values: list[float], alpha: float, start: float | None = None) -> list[float]:
    """The first value begins the average; each later one moves it by alpha."""
    out, m = [], start
    for v in values:
        m = v if m is None else m + alpha * (v - m)
        out.append(m)
    return out


def ewma_state(stream: DataFrame, key: str, step: str, x: str, alpha: float) -> DataFrame:
    """(key, step, level) of each row in step order: an average kept as state. A row whose step
    does not exceed the last one is left out, since what it would have changed has been used."""
    key_type = stream.schema[key].dataType.simpleString()
    step_type = stream.schema[step].dataType.simpleString()

    def run(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, last = state.get if state.exists else (None, None)
        rows = pd.concat(list(frames), ignore_index=True).sort_values(step, kind="stable")
        out = []
        for s, v in zip(rows[step].tolist(), rows[x].tolist(), strict=True):
            if v != v or (last is not None and s <= last):
                continue
            level = v if level is None else level + alpha * (v - level)
            last = s
            out.append((k[0], s, level))
        if level is not None:
            state.update((level, last))
        yield pd.DataFrame(out, columns=[key, step, "level"])

    return stream.groupBy(key).applyInPandasWithState(
        run, f"{key} {key_type}, {step} {step_type}, level double", f"level double, last {step_type}", "append", GroupStateTimeout.NoTimeout
    )


def matured(forecasts: DataFrame, realised: DataFrame, key: list[str], step: str, horizon: str) -> DataFrame:
    """Forecasts with the value of the row ``horizon`` steps later, and the residual: state may
    only change by forecasts whose step has come."""
    target = forecasts.withColumn("target_step", F.col(step) + F.col(horizon))
    r = realised.select(*key, F.col(step).alias("target_step"), F.col("actual"))
    return target.join(r, [*key, "target_step"]).withColumn("residual", F.col("actual") - F.col("prediction"))
