"""Weights of edges that decay by the day and change by events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Edge:
    """One edge. Decay is worked out when something is added; a weight that has fallen below ``least`` in between counts as gone."""

    def __init__(self, daily_decay: float, least: float = 1e-4):
        self.decay, self.least, self.weight, self.day = daily_decay, least, 0.0, None

    def at(self, day: int) -> float:
        if self.day is None:
            return 0.0
        # a weight that events leave is not dropped before a day has passed
        left = self.weight * self.decay ** (day - self.day)
        return left if day == self.day or abs(left) >= self.least else 0.0

    def add(self, day: int, amount: float) -> float:
        self.weight, self.day = self.at(day) + amount, day
        return self.weight


def edge_history(deltas: DataFrame, key: list[str], day: str, amount: str, daily_decay: float, least: float = 1e-4) -> DataFrame:
    """(key, day, weight): the weight of each edge after each day on which something was added to it.

    Rows are added up by day before they are dealt to tasks by edge and sorted; a task holds one edge's weight at a time. Null amounts count as 0."""
    daily = deltas.where(" and ".join(f"{c} is not null" for c in [*key, day])).groupBy(*key, day).agg(F.sum(F.coalesce(F.nanvl(F.col(amount), F.lit(0.0)), F.lit(0.0))).alias("_x"))
    kinds = ", ".join(f"{c} {daily.schema[c].dataType.simpleString()}" for c in [*key, day])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, edge = None, None
        for pdf in frames:
            out = []
            for *k, d, n, x in pdf[[*key, day, "_n", "_x"]].itertuples(index=False):
                if edge is None or k != now:
                    now, edge = k, Edge(daily_decay, least)
                out.append((*k, d, edge.add(n, x)))
            yield pd.DataFrame(out, columns=[*key, day, "weight"])

    dealt = daily.withColumn("_n", F.unix_date(F.col(day).cast("date"))).repartition(*key).sortWithinPartitions(*key, day)
    return dealt.mapInPandas(run, f"{kinds}, weight double")


def edges_on(history: DataFrame, key: list[str], day: str, on: Column, daily_decay: float, least: float = 1e-4) -> DataFrame:
    """(key, weight) of the edges that are left on a day: the last weight up to it, decayed since."""
    last = history.where(F.col(day) <= on).groupBy(*key).agg(F.max_by(F.struct(day, "weight"), day).alias("_l"))
    since = F.datediff(on, F.col(f"_l.{day}"))
    w = last.select(*key, F.when(since == 0, F.col("_l.weight")).otherwise(F.col("_l.weight") * F.pow(F.lit(daily_decay), since)).alias("weight"), since.alias("_s"))
    return w.where((F.col("_s") == 0) | (F.abs("weight") >= least)).drop("_s")
