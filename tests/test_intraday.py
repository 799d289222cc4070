"""Paths within sessions and residual surprise against plain loops."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import intraday, surprise

NAMES = ["ticker", "session", "minute", "open", "high", "low", "close", "volume"]
SCHEMA = "ticker string, session date, minute int, open double, high double, low double, close double, volume double"


def day(i):
    return dt.date(2024, 3, 1) + dt.timedelta(i)


def made(hours, tickers=2, sessions=14, gone=0.12, seed=5):
    """Bars by (ticker, session, minute) with some missing."""
    rng, out = np.random.default_rng(seed), {}
    labels = [hours.label + i * hours.interval for i in range(hours.bars)] + [hours.auction]
    for t in range(tickers):
        for d in range(sessions):
            for m in labels:
                if rng.random() < gone:
                    continue
                p = np.round(rng.uniform(5, 9, 4), 1)  # ties of highs and lows are wanted
                out[str(t), day(d), m] = (p[0], p.max(), p.min(), p[1], float(rng.integers(0, 50)))
    return out


def frame(spark, bars):
    return spark.createDataFrame([(*k, *map(float, v)) for k, v in bars.items()], SCHEMA)


def shock(values, window=5, least=2):
    """Each value less the median of the last rows before it."""
    out = []
    for i, x in enumerate(values):
        back = [v for v in values[max(0, i - window) : i] if v is not None]
        out.append(None if x is None or len(back) < least else x - float(np.median(back)))
    return out


def close_to(got, want, where):
    assert (got is None) == (want is None), where
    assert got is None or got == pytest.approx(want, abs=1e-9), where


@pytest.mark.parametrize("at_end", [False, True])
def test_decisions_and_paths_are_the_loops(spark, at_end):
    hours = intraday.Hours(30, 60, 300, 310, at_end)
    start, end, horizons = 90, 270, [30, 60, 120]
    bars = made(hours)
    n = hours.bars
    known, ahead = {}, {}
    for t in ("0", "1"):
        previous = None
        for d in range(14):
            slots = [bars.get((t, day(d), hours.label + i * 30)) for i in range(n)]
            auction = bars.get((t, day(d), hours.auction))
            first = slots[0][0] if slots[0] else None
            for i in range(n):
                minute = 60 + (i + 1) * 30
                if first is None or slots[i] is None or not start <= minute <= end:
                    continue
                price = slots[i][3]

                def edge(j):
                    return first if j == 0 else slots[j - 1][3] if slots[j - 1] else None

                def trailing(k, j0=i):
                    j = j0 + 1 - k
                    if j < 0 or any(x is None for x in slots[j : j0 + 1]) or edge(j) is None:
                        return None, None
                    path = [edge(j)] + [x[3] for x in slots[j : j0 + 1]]
                    return path[-1] / path[0] - 1, sum(abs(b / a - 1) for a, b in zip(path, path[1:]))

                there = [x for x in slots[: i + 1] if x]
                whole = len(there) == i + 1
                v = sum(x[4] for x in there)
                value = sum(sum(x[:4]) / 4 * x[4] for x in there)
                seen = [j for j in range(i) if slots[j]]
                last3 = slots[i - 2 : i + 1] if i >= 2 and all(slots[i - 2 : i + 1]) else None
                known[t, day(d), minute] = {
                    "decision_price": price, "clock_fraction": (minute - 60) / 240, "gap_open": previous and first / previous - 1, "return_from_previous_close": previous and price / previous - 1,
                    "return_from_open": price / first - 1, "return_1": trailing(1)[0], "return_3": trailing(3)[0], "return_6": trailing(6)[0], "absolute_return_3": trailing(3)[1], "absolute_return_6": trailing(6)[1],
                    "cumulative_range": max(x[1] for x in there) / min(x[2] for x in there) - 1 if whole else None,
                    "log_cumulative_volume": np.log1p(v) if whole else None, "log_cumulative_value": np.log1p(value) if whole else None,
                    "log_recent_volume_1": np.log1p(slots[i][4]), "log_recent_volume_3": np.log1p(sum(x[4] for x in last3)) if last3 else None,
                    "price_to_vwap": price / (value / v) - 1 if whole and v > 0 else None, "missing_since_previous": i - seen[-1] - 1 if seen else i, "missing_fraction": 1 - len(there) / (i + 1),
                }
                for h in [*horizons, 0]:
                    k = h // 30 if h else n - 1 - i
                    path = slots[i + 1 : i + 1 + k]
                    times = [30 * (j + 1) for j in range(k)]
                    if h == 0:
                        path, times = path + [auction], times + [hours.auction - minute]
                    o = dict.fromkeys(("endpoint_return", "mfe", "mae", "absolute_return", "future_range", "time_to_peak", "time_to_trough", "_v"))
                    if i + k < n and path[-1]:
                        o["endpoint_return"] = path[-1][3] / price - 1
                        if all(path):
                            hi, lo, c = [x[1] for x in path], [x[2] for x in path], [price] + [x[3] for x in path]
                            o |= {"mfe": max(hi) / price - 1, "mae": min(lo) / price - 1, "absolute_return": sum(abs(b / a - 1) for a, b in zip(c, c[1:])), "future_range": max(*hi, price) / min(*lo, price) - 1}
                            o |= {"time_to_peak": times[int(np.argmax(hi))] / times[-1], "time_to_trough": times[int(np.argmin(lo))] / times[-1], "_v": np.log1p(sum(x[4] for x in path))}
                    ahead[t, day(d), minute, h] = o
            previous = auction[3] if auction else previous
    for key in {(t, m) for t, _, m in known}:
        rows = [known[k] for k in sorted(k for k in known if (k[0], k[2]) == key)]
        for name, x in intraday.SHOCKS.items():
            values = [None if r["absolute_return_3"] is None else np.log1p(10_000 * r["absolute_return_3"]) for r in rows] if x.startswith("_") else [r[x] for r in rows]
            for r, s in zip(rows, shock(values)):
                r[name] = s
    for key in {(t, m, h) for t, _, m, h in ahead}:
        rows = [ahead[k] for k in sorted(k for k in ahead if (k[0], k[2], k[3]) == key)]
        for r, s in zip(rows, shock([r.pop("_v") for r in rows])):
            r["future_volume_shock"] = s
    df = frame(spark, bars)
    got = {(r["ticker"], r["session"], r["minute"]): r for r in intraday.decisions(df, hours, start, end, window=5, least=2).collect()}
    assert got.keys() == known.keys() and len(got) > 60
    for k, want in known.items():
        for c, x in want.items():
            close_to(got[k][c], x, (k, c))
    got = {(r["ticker"], r["session"], r["minute"], r["horizon"]): r for r in intraday.path_targets(df, hours, start, end, horizons, 5, 2).collect()}
    assert got.keys() == ahead.keys()
    for k, want in ahead.items():
        for c, x in want.items():
            close_to(got[k][c], x, (k, c))


def test_later_bars_change_no_decision(spark):
    hours = intraday.Hours(30, 60, 300, 310)
    bars = made(hours, 1, 6, 0.05, 9)
    cut = {k: v for k, v in bars.items() if k[1] < day(5) or k[2] + 30 <= 180}
    rows = lambda b: sorted(map(tuple, intraday.decisions(frame(spark, b), hours, 90, 180, window=5, least=2).collect()), key=str)
    assert rows(bars) == rows(cut)


def test_invalid_bars_are_missing_and_repeated_ones_an_error(spark):
    hours = intraday.Hours(60, 0, 180, 180)
    one = (5.0, 6.0, 4.0, 5.0, 1.0)
    good = {("a", day(0), m): one for m in (0, 60, 120, 180)}
    odd = [("a", day(1), 0, *one), ("a", day(1), 60, 5.0, 6.0, 0.0, 5.0, 1.0), ("a", day(1), 61, *one), (None, day(1), 0, *one), ("a", None, 0, *one), ("a", day(1), None, *one)]
    odd += [("b", day(0), 0, 5.0, None, 4.0, 5.0, 1.0), ("b", day(0), 60, float("nan"), 6.0, 4.0, 5.0, 1.0), ("b", day(0), 120, 5.0, 6.0, 4.0, 5.0, None), ("b", day(0), 180, 5.0, 6.0, 4.0, 5.0, -1.0)]
    df = spark.createDataFrame([(*k, *v) for k, v in good.items()] + odd, SCHEMA).withColumn("slot", F.lit("x")).withColumn("bar", F.lit(1)).withColumn("auction", F.lit(2))
    got = intraday.decisions(df, hours, 60, 120).orderBy("session", "minute").collect()
    assert [(r["ticker"], r["session"], r["minute"], r["gap_open"]) for r in got] == [("a", day(0), 60, None), ("a", day(0), 120, None), ("a", day(1), 60, 0.0)]
    assert intraday.path_targets(df, hours, 60, 60, [60]).count() == 4
    labels = {(r["ticker"], r["session"]): (r["bars"], r["last_minute"], r["complete"]) for r in intraday.session_labels(df, hours).collect()}
    assert labels == {("a", day(0)): (4, 180, True), ("a", day(1)): (2, 61, False)}
    assert intraday.decisions(df.limit(0), hours, 60, 120).count() == 0 and intraday.systemic_summary(intraday.path_targets(df.limit(0), hours, 60, 120, [60])).count() == 0
    with pytest.raises(Exception, match="[Dd]uplicate"):
        intraday.decisions(df.union(df), hours, 60, 120).collect()
    for wrong in ((0, 0, 180, 180, False), (50, 0, 180, 180, False), (60, 0, 180, 120, False), (60, 0, 180, 180, True)):
        with pytest.raises(ValueError):
            intraday.Hours(*wrong)
    with pytest.raises(ValueError):
        intraday.decisions(df, hours, 30, 120)


def test_early_window(spark):
    hours = intraday.Hours(30, 60, 300, 310, True)
    bar = lambda c, v: (5.0, 7.0, 4.0, c, v)
    bars = {("a", day(0), 90): bar(5.0, 1.0), ("a", day(0), 120): bar(6.0, 2.0), ("a", day(0), 150): bar(9.0, 9.0), ("b", day(0), 90): bar(6.0, 1.0), ("b", day(0), 100): bar(3.0, 1.0), ("c", day(0), 150): bar(1.0, 1.0)}
    got = {r["ticker"]: r for r in intraday.early_window(frame(spark, bars), hours, 120).collect()}
    assert set(got) == {"a", "b"}
    a, b = got["a"], got["b"]
    assert (a["bars"], a["coverage"], a["complete"], a["early_volume"], a["decision_price"]) == (2, 1.0, True, 3.0, 6.0)
    assert a["absolute_return"] == pytest.approx(0.2) and a["early_return"] == pytest.approx(0.2) and a["early_value"] == pytest.approx(5.25 + 11.0)
    assert (b["bars"], b["coverage"], b["complete"]) == (2, 0.5, False) and b["absolute_return"] == pytest.approx(0.2 + 0.5)


def test_systemic_sets_are_gated_apart(spark):
    rows = [(str(i), 0, 60, 30, r, m, -0.1, 0.2, v) for i, (r, m, v) in enumerate([(0.1, 0.2, None), (-0.3, None, 1.0), (0.0, 0.1, None), (None, None, 0.1)])]
    t = spark.createDataFrame(rows, "ticker string, session int, minute int, horizon int, endpoint_return double, mfe double, mae double, future_range double, future_volume_shock double")
    got = intraday.systemic_summary(t, 2).collect()[0]
    r = np.array([0.1, -0.3, 0.0])
    assert got["median_return"] == 0.0 and got["mean_return"] == pytest.approx(r.mean()) and got["return_dispersion"] == pytest.approx(r.std()) and got["direction_coherence"] == pytest.approx(abs(r.mean()) / np.abs(r).mean())
    assert (got["positive_breadth"], got["negative_breadth"], got["move_breadth"]) == pytest.approx((1 / 3, 1 / 3, 2 / 3))
    assert got["median_mfe"] == pytest.approx(0.15) and got["state_change_energy"] == pytest.approx(np.sqrt(np.mean([0.1**2 + 0.01, 0.01])))
    assert got["median_volume_shock"] == pytest.approx(0.55) and got["volume_expansion_breadth"] == 0.5
    got = intraday.systemic_summary(t, 3).collect()[0]
    assert got["median_return"] == 0.0 and got["median_mfe"] is None and got["median_volume_shock"] is None


@pytest.mark.parametrize("weighed", [True, False])
def test_residual_surprise_is_the_loop(spark, weighed):
    rng = np.random.default_rng(11)
    steps, nodes, features, least = 9, 8, 5, 4
    x = np.where(rng.random((steps, nodes, features)) < 0.3, np.nan, rng.normal(0.4, 2, (steps, nodes, features)))
    x[2, 3:] = np.nan  # too few nodes
    x[3] = np.where(np.isnan(x[3]), np.nan, 1.0)  # at the centre: no common part
    center, scale = np.full(features, 1.0), np.linspace(0.3, 2, features)
    edges = [(a, b, float(rng.choice([-0.5, 1.0, 2.0])) if weighed else 0.0) for a in range(nodes) for b in range(nodes) if a != b and rng.random() < 0.3] + [(0, 99, 1.0)]
    z = np.clip((x - center) / scale, -1.5, 1.5)
    want = {}
    for s in range(steps):
        use = (~np.isnan(z[s])).sum(0) >= least
        full = (~np.isnan(z[s][:, use])).sum(1) >= max(1, np.ceil(use.sum() / 4))
        if not use.any() or full.sum() < least:
            continue
        common = np.nanmedian(z[s][:, use], axis=0)
        picked = z[s][full][:, use]
        energy = np.sqrt(np.nanmean(picked**2, axis=1))
        ce, te = np.sqrt(np.mean(common**2)), np.sqrt(np.nanmean(picked**2))
        part = np.mean(energy >= 1.0)
        useful = np.abs(common) > 1e-8
        side = [np.nan if np.isnan(row[useful]).all() else np.nanmean(row[useful] * np.sign(common[useful])) for row in z[s][:, use]]
        pairs = [(np.sign(side[a]) * np.sign(side[b]), w) for a, b, w in edges if b < nodes and np.isfinite(side[a]) and np.isfinite(side[b])]
        agree = 0.0 if not useful.any() else sum(g * w for g, w in pairs) / sum(abs(w) for _, w in pairs) if weighed else np.mean([g for g, _ in pairs])
        mid = np.median(energy)
        want[s] = (ce, te, mid, np.quantile(energy, 0.75), part, min(1, ce / te) if te > 1e-12 else 0.0, agree, np.sqrt(ce**2 + mid**2 * part))
    rows = [(s, n, str(f), None if np.isnan(x[s, n, f]) else float(x[s, n, f])) for s in range(steps) for n in range(nodes) for f in range(features)] + [(0, 0, "unscaled", 1.0), (0, 0, "flat", 1.0)]
    long = spark.createDataFrame(rows, "step int, node int, feature string, residual double")
    scales = spark.createDataFrame([(str(f), float(center[f]), float(scale[f])) for f in range(features)] + [("flat", 0.0, 0.0)], "feature string, center double, scale double")
    e = spark.createDataFrame(edges, "src int, dst int, weight double")
    zs = surprise.standardised(long, scales, 1.5)
    got = {r["step"]: tuple(r)[1:] for r in surprise.residual_surprise(zs, e, least).collect()}
    assert got.keys() == want.keys() and 2 not in got and got[3][6] == 0.0
    for s in want:
        assert got[s] == pytest.approx(want[s], abs=1e-9)
    assert {r["edge_agreement"] for r in surprise.residual_surprise(zs, None, least).collect()} == {None}
    assert surprise.residual_surprise(zs.limit(0), e, least).count() == 0
