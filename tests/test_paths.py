"""Open-shock paths, peaks and weights of signals against plain loops."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import paths

D = dt.date


def test_open_shock_is_the_loop(spark):
    rng = np.random.default_rng(3)
    dates, nodes, hs, least = 12, 9, [1, 2, 5], 5
    gap = np.where(rng.random((dates, nodes)) < 0.15, np.nan, rng.normal(0.01, 0.02, (dates, nodes)))
    gap[4] = np.nan
    gap[5, :6] = 0.0
    close = np.where(rng.random((dates, 3, nodes)) < 0.3, np.nan, rng.normal(0, 0.03, (dates, 3, nodes)))
    close[2, 1] = np.nan  # no valid second horizon on this date
    day = lambda t: D(2024, 1, 1) + dt.timedelta(t)
    none = lambda x: None if np.isnan(x) else float(x)
    gaps = spark.createDataFrame([(day(t), str(i), none(gap[t, i])) for t in range(dates) for i in range(nodes)], "date date, ticker string, gap double")
    closes = spark.createDataFrame([(day(t), str(i), h, none(close[t, k, i])) for t in range(dates) for k, h in enumerate(hs) for i in range(nodes)] + [(day(0), "0", 99, 1.0)], "date date, ticker string, horizon int, from_open double")
    got = {(r["date"], r["horizon"]): r.asDict() for r in paths.open_shock(gaps, closes, hs, least).collect()}
    seen = set()
    for t in range(dates):
        ok = np.isfinite(gap[t])
        if ok.sum() < least:
            continue
        g = gap[t, ok]
        direction = np.sign(np.median(g) if abs(np.median(g)) > 1e-12 else g.mean())
        if direction == 0:
            continue
        breadth = direction * np.sign(g).mean()
        market, own = {}, np.full((3, nodes), np.nan)
        for k, h in enumerate(hs):
            v = ok & np.isfinite(close[t, k])
            if v.sum() < least:
                continue
            f, total = close[t, k, v], (1 + gap[t, v]) * (1 + close[t, k, v]) - 1
            market[h] = direction * np.median(f)
            own[k, v] = direction * f
            up = own[: k + 1][:, np.isfinite(own[: k + 1]).any(0)]
            best = max(market.values())
            want = {
                "direction": direction, "open_breadth": breadth, "open_median": np.median(g), "open_energy": np.sqrt(np.median(g) ** 2 + (np.median(abs(g)) * max(breadth, 0)) ** 2), "remaining": np.median(f), "aligned_total": direction * np.median(total),
                "extension": direction * np.median(total) - abs(np.median(g)), "aligned_breadth": (direction * np.sign(total)).mean(), "continuation": (direction * f > 0).mean(), "market_mfe": best, "market_mae": min(market.values()),
                "time_to_peak": min(x for x, y in market.items() if y == best), "node_mfe": np.median(np.nanmax(up, 0)), "node_mae": np.median(np.nanmin(up, 0)),
            }
            r = got[day(t), h]
            assert {c: r[c] for c in want} == pytest.approx(want), (t, h)
            seen.add((day(t), h))
    assert set(got) == seen and len(seen) > 20 and (day(2), 2) not in seen and (day(4), 1) not in seen


def test_peaks_and_their_selection(spark):
    rows = [("fit", d, h, float((d * h) % 7)) for d in range(25) for h in (1, 2, 3)] + [("test", 99, 1, 5.0), ("test", 98, 1, 0.0), ("test", 98, 2, 0.0)]
    df = spark.createDataFrame(rows, "split string, date int, h int, x double")
    p = {(r["split"], r["date"]): r for r in paths.path_peaks(df, "split", "date", "h", "x", "fit").collect()}
    best = sorted(max(float((d * h) % 7) for h in (1, 2, 3)) for d in range(25))
    assert all(r["major_event"] == (r["path_salience"] >= np.quantile(best, 0.9)) for r in p.values())
    assert (p["test", 99]["second_horizon"], p["test", 98]["peak_horizon"], p["test", 98]["relative_margin"]) == (-1, 2, 0.0) and p["fit", 3]["peak_horizon"] == 2 and p["fit", 3]["relative_margin"] == pytest.approx(0.5)
    with pytest.raises(Exception, match="twenty"):
        paths.path_peaks(df.where("date > 10"), "split", "date", "h", "x", "fit").collect()
    s = paths.selected_peaks(df.where("split = 'fit'"), "date", "x", "h", rate=0.1)
    assert s.count() == 3 and paths.selected_peaks(df, "date", "x", "h", threshold=6.0).where("x < 6").count() == 0


def test_classification_weights_and_correlations(spark):
    c = spark.createDataFrame([("a", 0.9, 1), ("a", 0.2, 1), ("a", 0.4, 0), ("b", 1.0, 1), ("a", None, 1)], "g string, p double, y int")
    r = {x["g"]: x for x in paths.classification(c, "g", "p", "y", F.lit(0.5)).collect()}
    assert (r["a"]["rows"], r["a"]["balanced_accuracy"], r["a"]["brier"]) == (3, 0.75, pytest.approx((0.01 + 0.64 + 0.16) / 3)) and r["b"]["balanced_accuracy"] == 1.0 and r["b"]["brier_skill"] == pytest.approx(1.0)
    ic = lambda rows: {x["s"]: x["weight"] for x in paths.positive_ic_weights(spark.createDataFrame(rows, "s string, ic double"), "s", "ic").collect()}
    assert ic([("a", 0.2), ("a", 0.4), ("b", -0.5), ("c", 0.1), ("c", None)]) == pytest.approx({"a": 0.75, "b": 0.0, "c": 0.25}) and ic([("a", -0.1), ("b", -0.2)]) == {"a": 0.5, "b": 0.5}
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3, 15, 3))
    x[1, :6, 0] = np.nan
    rows = [(t, str(i), *[None if np.isnan(v) else float(v) for v in x[t, i]]) for t in range(3) for i in range(15)]
    got = {(r["a"], r["b"]): (r["dates"], r["correlation"]) for r in paths.signal_correlations(spark.createDataFrame(rows, "date int, ticker string, u double, v double, w double"), ["u", "v", "w"]).collect()}
    assert got["u", "v"] == (2, pytest.approx(np.mean([np.corrcoef(x[t, :, 0], x[t, :, 1])[0, 1] for t in (0, 2)]))) and got["v", "w"][0] == 3
