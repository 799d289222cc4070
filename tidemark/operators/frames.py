"""Row frames by entity and date, with the gate that a rolling value needs a full window."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by(key: str = "ticker", order: str = "date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def last_rows(n: int, key: str = "ticker", order: str = "date") -> WindowSpec:
    """The current row and the n-1 before it."""
    return by(key, order).rowsBetween(-(n - 1), 0)


def prior_rows(n: int, key: str = "ticker", order: str = "date") -> WindowSpec:
    """The n rows before the current one: what was known when it began."""
    return by(key, order).rowsBetween(-n, -1)


def full(value: Column, x: Column, frame: WindowSpec, n: int) -> Column:
    """``value`` over ``frame`` where ``x`` has n non-null rows there, else null."""
    return F.when(F.count(x).over(frame) >= n, value.over(frame))
