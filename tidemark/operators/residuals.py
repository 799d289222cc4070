"""Corrections of forecasts by their matured errors. Each class is the state of one group (a horizon's feature): it takes the steps one by one, in order, and
uses an error only at the step at which its target has come."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Innovation:
    """Averages of matured errors: one for all nodes (of the step's median error), one for each node, mixed by ``node_mix``.

    A forecast of step s for s + horizon is corrected with what had matured by s, and its corrected value waits for its target."""

    columns = ("prediction", "target")
    output = "corrected double, correction double"

    def __init__(self, horizon: int, alpha: float, node_mix: float, clip: float):
        self.horizon, self.alpha, self.mix, self.clip = horizon, alpha, node_mix, clip
        self.common, self.nodes, self.pending = 0.0, {}, {}

    def step(self, step: int, nodes: list, prediction: np.ndarray, target: np.ndarray) -> list[tuple]:
        made = self.pending.pop(step, {})
        errors = {n: float(np.clip(t - made[n], -self.clip, self.clip)) for n, t in zip(nodes, target, strict=True) if n in made and np.isfinite(t)}
        # what no row brought to maturity can never come
        self.pending = {s: p for s, p in self.pending.items() if s > step}
        if errors:
            if self.mix < 1:
                self.common += self.alpha * (float(np.median(list(errors.values()))) - self.common)
            if self.mix > 0:
                for n, e in errors.items():
                    self.nodes[n] = self.nodes.get(n, 0.0) + self.alpha * (e - self.nodes.get(n, 0.0))
        correction = [float(np.clip((1 - self.mix) * self.common + self.mix * self.nodes.get(n, 0.0), -self.clip, self.clip)) for n in nodes]
        corrected = [float(p + c) if np.isfinite(p) else None for p, c in zip(prediction, correction, strict=True)]
        self.pending[step + self.horizon] = {n: c for n, c in zip(nodes, corrected, strict=True) if c is not None}
        return list(zip(corrected, correction, strict=True))


class OnlineResidual:
    """A bias and a gain on the last matured error, both as exponential averages over steps of the nodes' means.

    error at step s: of the forecast made at s, known at s + horizon. The gain is used once it has been updated ``min_updates`` times."""

    columns = ("error",)
    output = "bias_correction double, correction double"

    def __init__(self, horizon: int, alpha: float, bias_clip: float, gain_clip: float, correction_clip: float, ridge: float, min_updates: int):
        self.horizon, self.alpha, self.clips, self.ridge, self.least = horizon, alpha, (bias_clip, gain_clip, correction_clip), ridge, min_updates
        self.errors: list[dict] = []  # of the last 2 * horizon steps, and this one
        self.bias, self.moments, self.seen, self.gains = 0.0, np.zeros(3), 0, 0

    def _mean(self, old, new, count):
        return new if count == 0 else old + self.alpha * (new - old)

    def step(self, step: int, nodes: list, error: np.ndarray) -> list[tuple]:
        self.errors = [*self.errors[-2 * self.horizon :], {n: float(e) for n, e in zip(nodes, error, strict=True) if np.isfinite(e)}]
        matured = self.errors[-1 - self.horizon] if len(self.errors) > self.horizon else None
        before = self.errors[-1 - 2 * self.horizon] if len(self.errors) > 2 * self.horizon else None
        b, g, c = self.clips
        if matured:
            self.bias = float(np.clip(self._mean(self.bias, np.mean(list(matured.values())), self.seen), -b, b))
            self.seen += 1
        if matured and before is not None:
            both = np.array([(before[n], matured[n]) for n in matured if n in before])
            if len(both):
                x, y = both.T
                self.moments = self._mean(self.moments, np.array([x.mean(), (x * x).mean(), (x * y).mean()]), self.gains)
                self.gains += 1
        x, xx, xy = self.moments
        gain = (xy - self.bias * x) / (xx + self.ridge) if xx + self.ridge > 1e-12 else 0.0
        gain = float(np.clip(gain, -g, g)) if self.gains >= self.least else None
        plain = float(np.clip(self.bias, -c, c))
        out = []
        for n in nodes:
            moved = self.bias + matured[n] * gain if matured and n in matured and gain is not None else self.bias
            out.append((plain, float(np.clip(moved, -c, c))))
        return out


def corrected(rows: DataFrame, group: list[str], step: str, node: str, fresh: Callable[[], object], values: dict[str, str]) -> DataFrame:
    """(group, step, node) with the state's output, for rows of every node and step.

    A group is one sequence of steps: rows are dealt to tasks by group and sorted by step, and a task holds the state (a number a node and the steps that are
    still to mature), never the rows. fresh makes the state; values name the column of each of its inputs. Rows that share step and node count each for itself."""
    state = fresh()
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in [*group, step, node])
    names = [x.split()[0] for x in state.output.split(", ")]
    inputs = [values[c] for c in state.columns]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, s, held = None, None, []

        def flush() -> pd.DataFrame:
            pdf = held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
            got = s.step(int(pdf[step].iloc[0]), pdf[node].tolist(), *[pdf[c].to_numpy(dtype=float) for c in inputs])
            return pd.concat([pdf[[*group, step, node]].reset_index(drop=True), pd.DataFrame(got, columns=names)], axis=1)

        for pdf in frames:
            out = []
            for key, part in pdf.groupby([*group, step], sort=False, dropna=False):
                if held and key != now:
                    out.append(flush())
                    held.clear()
                if s is None or now is None or key[:-1] != now[:-1]:
                    s = fresh()
                now = key
                held.append(part)
            if out:
                yield pd.concat(out, ignore_index=True)
        if held:
            yield flush()

    some = rows.where(f"{step} is not null and {node} is not null").select(*group, step, node, *inputs)
    return some.repartition(*group).sortWithinPartitions(*group, step, node).mapInPandas(run, f"{kinds}, {state.output}")
