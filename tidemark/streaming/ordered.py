"""State that takes its rows in the order of their time, whatever the order of their coming.

Rows of a key wait in its state until the watermark has passed their period; a timer in event time then folds them, oldest first. So a late row within the
watermark's delay counts as if it had come in time, and the result equals the batch over all rows. A row whose period has been folded is left out."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.edge_state import Edge

DAY_MS = 86_400_000


def in_order(stream: DataFrame, key: list[str], at: str, period_ms: int, columns: list[str], output: str, fresh: Callable[[], object], fold: Callable[[object, int, list[tuple]], list[tuple]], delay: str) -> DataFrame:
    """(key, period, output) of each folded period of a key. period counts ``period_ms`` from the epoch; fold changes the state, given the period's rows, sorted.

    Rows without time or key are left out."""
    names = [x.strip().split()[0] for x in output.split(", ")]
    kinds = ", ".join(f"{c} {stream.schema[c].dataType.simpleString()}" for c in key)
    some = stream.where(" and ".join(f"{c} is not null" for c in [*key, at])).select(*key, at, *columns).withWatermark(at, delay)
    timed = some.withColumn("_period", F.floor(F.unix_millis(F.col(at).cast("timestamp")) / period_ms))

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, last, waiting = pickle.loads(state.get[0]) if state.exists else (fresh(), None, {})
        for pdf in frames:
            for p, *row in pdf[["_period", *columns]].itertuples(index=False):
                if last is None or p > last:
                    waiting.setdefault(int(p), []).append(tuple(row))
        mark = state.getCurrentWatermarkMs()
        out = []
        for p in sorted(p for p in waiting if (p + 1) * period_ms <= mark):
            out += [(*k, p, *r) for r in fold(value, p, sorted(waiting.pop(p), key=repr))]
            last = p
        state.update((pickle.dumps((value, last, waiting)),))
        if waiting:
            state.setTimeoutTimestamp(max((min(waiting) + 1) * period_ms, mark + 1))
        yield pd.DataFrame(out, columns=[*key, "period", *names])

    return timed.groupBy(*key).applyInPandasWithState(run, f"{kinds}, period long, {output}", "blob binary", "append", GroupStateTimeout.EventTimeTimeout)


def edge_store(stream: DataFrame, key: list[str], at: str, amount: str, daily_decay: float, delay: str, least: float = 1e-4) -> DataFrame:
    """(key, period, weight): an edge's weight after each day on which something was added to it; period is the day from the epoch."""

    def fold(edge: Edge, day: int, rows: list[tuple]) -> list[tuple]:
        return [(edge.add(day, sum(x for (x,) in rows if x == x)),)]

    return in_order(stream, key, at, DAY_MS, [amount], "weight double", lambda: Edge(daily_decay, least), fold, delay)


def innovations(stream: DataFrame, group: list[str], at: str, period_ms: int, node: str, fresh: Callable[[], object], values: dict[str, str], delay: str) -> DataFrame:
    """(group, period, node, output): forecasts corrected by their matured errors (``operators.residuals``), step by step as time passes; a step is a period."""
    made = fresh()
    kind = stream.schema[node].dataType.simpleString()

    def fold(state, step: int, rows: list[tuple]) -> list[tuple]:
        import numpy as np

        rows = sorted(rows)
        nodes, *xs = zip(*rows, strict=True)
        return [(n, *o) for n, o in zip(nodes, state.step(step, list(nodes), *[np.array([np.nan if v is None else v for v in x], dtype=float) for x in xs]), strict=True)]

    return in_order(stream, group, at, period_ms, [node, *[values[c] for c in made.columns]], f"{node} {kind}, {made.output}", fresh, fold, delay)
