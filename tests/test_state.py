"""Edges that decay, forecasts that mature, extended releases and ordered streams, against plain loops."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import causal, edge_state, events, metrics, residuals, screens
from tidemark.streaming import ordered, replay

D = dt.date
T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def edges_by_day(deltas, decay, least=1e-4):
    """The store that is aged every day and then takes the day's deltas."""
    weights, out = {}, {}
    for day in range(max(d for _, d, _ in deltas) + 1):
        for k in list(weights):
            weights[k] *= decay
            if abs(weights[k]) < least:
                del weights[k]
        for k in {k for k, d, _ in deltas if d == day}:
            weights[k] = weights.get(k, 0.0) + sum(x for q, d, x in deltas if (q, d) == (k, day))
            out[k, day] = weights[k]
    return out, weights


def random_deltas(seed):
    rng = random.Random(seed)
    return [(rng.choice("abc"), rng.randrange(30), rng.choice([0.5, -0.3, 0.00011, 1.0])) for _ in range(70)]


def test_edge_history_is_the_store(spark):
    deltas = random_deltas(1)
    df = spark.createDataFrame([(k, "t", D(2024, 1, 1) + dt.timedelta(d), x) for k, d, x in deltas] + [(None, "t", D(2024, 1, 1), 1.0), ("a", "t", D(2024, 1, 1), None)], "src string, dst string, day date, x double").repartition(4)
    h = edge_state.edge_history(df, ["src", "dst"], "day", "x", 0.3)
    want, left = edges_by_day([*deltas, ("a", 0, 0.0)], 0.3)
    got = {(r["src"], (r["day"] - D(2024, 1, 1)).days): r["weight"] for r in h.collect()}
    assert got == pytest.approx(want)
    last = D(2024, 1, 1) + dt.timedelta(max(d for _, d, _ in deltas))
    assert {r["src"]: r["weight"] for r in edge_state.edges_on(h, ["src", "dst"], "day", F.lit(last), 0.3).collect()} == pytest.approx(left)


def files_stream(spark, tmp_path, batches, schema):
    """A stream that takes one file at a time, in this order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in (tmp_path / "in").glob("part-*"):
            f.rename(tmp_path / "in" / f"done-{i:03d}.parquet")
            import os

            os.utime(tmp_path / "in" / f"done-{i:03d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    s = spark.read.parquet(str(tmp_path / "in")).schema
    return spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_stream_of_edges_with_late_rows_is_the_batch(spark, tmp_path):
    deltas = random_deltas(2)
    at = lambda d: T0 + dt.timedelta(days=d, hours=5)
    late = [x for x in deltas if x[1] in (8, 9)]  # they come with days 10 to 12, within the delay of three days
    in_time = sorted((x for x in deltas if x not in late), key=lambda x: x[1])
    batches = [[x for x in in_time if a <= x[1] < a + 4] + (late if a == 12 - 2 else []) for a in (0, 4, 8, 10, 14, 18, 22, 26)]
    batches = [[x for x in in_time if a <= x[1] < z] + (late if a == 10 else []) for a, z in ((0, 4), (4, 8), (8, 10), (10, 12), (12, 20), (20, 30))]
    batches += [[("z", 40, 0.0)], [("a", 2, 99.0), ("z", 41, 0.0)]]  # the end; and a row whose day is long past
    s = files_stream(spark, tmp_path, [[(k, at(d), x) for k, d, x in b] for b in batches], "src string, ts timestamp, x double")
    got = {(r["src"], r["period"] - 19723): r["weight"] for r in replay.replayed(ordered.edge_store(s, ["src"], "ts", "x", 0.3, "3 days"), "t").collect()}
    want, _ = edges_by_day([x for b in batches for x in b if x[2] != 99.0], 0.3)
    assert got == pytest.approx({k: v for k, v in want.items() if k[0] != "z"}) and len(late) > 2


def innovation_loop(rows, horizon, alpha, mix, clip):
    common, nodes, pending, out = 0.0, {}, {}, {}
    for s in sorted({r[1] for r in rows}):
        now = sorted((r for r in rows if r[1] == s), key=lambda r: r[2])
        made = pending.pop(s, {})
        e = {n: max(-clip, min(clip, t - made[n])) for _, _, n, p, t in now if n in made and t is not None}
        if e:
            common += alpha * (float(np.median(list(e.values()))) - common)
            for n, x in e.items():
                nodes[n] = nodes.get(n, 0.0) + alpha * (x - nodes.get(n, 0.0))
        for _, _, n, p, _t in now:
            c = max(-clip, min(clip, (1 - mix) * common + mix * nodes.get(n, 0.0)))
            out[s, n] = (None if p is None else p + c, c)
            if p is not None:
                pending.setdefault(s + horizon, {})[n] = p + c
    return out


def random_forecasts(seed, steps=25, nodes=6):
    rng = random.Random(seed)
    return [("f", s, n, None if rng.random() < 0.1 else rng.gauss(0, 1), None if rng.random() < 0.1 else rng.gauss(0.4 * n, 1)) for s in range(steps) for n in range(nodes) if rng.random() < 0.9 and s != 7]


@pytest.mark.parametrize("mix", [0.0, 0.4, 1.0])
def test_innovations_are_the_loop_and_use_nothing_unmatured(spark, mix):
    rows = random_forecasts(3)
    schema, fresh = "g string, s long, n long, p double, t double", lambda: residuals.Innovation(3, 0.3, mix, 1.5)
    run = lambda rs: {(r["s"], r["n"]): (r["corrected"], r["correction"]) for r in residuals.corrected(spark.createDataFrame(rs, schema).repartition(3), ["g"], "s", "n", fresh, {"prediction": "p", "target": "t"}).collect()}
    got, want = run(rows), innovation_loop(rows, 3, 0.3, mix, 1.5)
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    moved = run([(g, s, n, p, None if t is None else t + 100 * (s >= 15)) for g, s, n, p, t in rows])
    assert all(moved[k] == got[k] for k in got if k[0] < 15) and any(moved[k] != got[k] for k in got if k[0] >= 15)


def test_stream_of_innovations_with_late_rows_is_the_batch(spark, tmp_path):
    rows = random_forecasts(4, 14)
    schema = "g string, ts timestamp, n long, p double, t double"
    late = [r for r in rows if r[1] == 5 and r[2] < 3]
    timed = lambda rs: [(g, T0 + dt.timedelta(days=s, hours=1), n, p, t) for g, s, n, p, t in rs]
    batches = [[r for r in rows if a <= r[1] < a + 3 and r not in late] + (late if a == 6 else []) for a in (0, 3, 6, 9, 12)]
    s = files_stream(spark, tmp_path, [*map(timed, batches), timed([("z", 60, 0, 0.0, 0.0)])], schema)
    fresh = lambda: residuals.Innovation(2, 0.3, 0.5, 1.5)
    out = ordered.innovations(s, ["g"], "ts", ordered.DAY_MS, "n", fresh, {"prediction": "p", "target": "t"}, "4 days")
    got = {(r["period"] - 19723, r["n"]): r["corrected"] for r in replay.replayed(out, "i").where("g = 'f'").collect()}
    want = {k: v[0] for k, v in innovation_loop(rows, 2, 0.3, 0.5, 1.5).items()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) if want[k] is not None else got[k] is None or got[k] != got[k] for k in want)


def test_online_residuals_are_the_loop(spark):
    rng = np.random.default_rng(5)
    e = rng.normal(0.1, 0.3, size=(40, 4))
    e[rng.random(e.shape) < 0.1] = np.nan
    rows = [("f", s, n, float(e[s, n])) for s in range(40) for n in range(4)]
    h, alpha, bc, gc, cc, ridge, least = 2, 0.2, 0.3, 0.9, 0.4, 1e-3, 4
    fresh = lambda: residuals.OnlineResidual(h, alpha, bc, gc, cc, ridge, least)
    got = {(r["s"], r["n"]): (r["bias_correction"], r["correction"]) for r in residuals.corrected(spark.createDataFrame(rows, "g string, s long, n long, e double"), ["g"], "s", "n", fresh, {"error": "e"}).collect()}
    bias, m, seen, gains = 0.0, np.zeros(3), 0, 0
    for s in range(40):
        if s >= h:
            y = e[s - h]
            bias = np.nanmean(y) if not seen else bias + alpha * (np.nanmean(y) - bias)
            bias, seen = float(np.clip(bias, -bc, bc)), seen + 1
            if s >= 2 * h:
                x = e[s - 2 * h]
                ok = np.isfinite(x) & np.isfinite(y)
                new = np.array([x[ok].mean(), (x[ok] ** 2).mean(), (x[ok] * y[ok]).mean()])
                m, gains = new if not gains else m + alpha * (new - m), gains + 1
        gain = float(np.clip((m[2] - bias * m[0]) / (m[1] + ridge), -gc, gc)) if gains >= least else 0.0
        for n in range(4):
            last = e[s - h, n] if s >= h else np.nan
            want = bias + (last * gain if np.isfinite(last) else 0.0)
            assert got[s, n] == pytest.approx((np.clip(bias, -cc, cc), np.clip(want, -cc, cc)))


BARS = "ticker string, date date, open double, high double, low double, close double, volume double, adjusted_open double, adjusted_high double, adjusted_low double, adjusted_close double, adjusted_volume double"


def bars(ticker, closes, factors, start=0):
    return [(ticker, D(2024, 1, 1) + dt.timedelta(start + i), c - 1, c + 1, c - 2, c, 100.0 + start + i, (c - 1) * f, (c + 1) * f, (c - 2) * f, c * f, (100.0 + start + i) / f) for i, (c, f) in enumerate(zip(closes, factors, strict=True))]


def test_extension_is_the_full_build_and_checks_its_bridge(spark):
    closes = [100.0, 104.0, 51.0, 53.0, 50.0, 25.5, 26.0]
    whole = bars("a", closes, [0.25, 0.25, 0.5, 0.5, 0.5, 1, 1])
    early = bars("a", closes[:4], [0.5, 0.5, 1, 1])
    late = bars("a", closes[3:], [0.5, 0.5, 1, 1], 3)
    df = lambda rows: spark.createDataFrame(rows, BARS)
    full = causal.causal_bars(df(whole)).orderBy("date").collect()
    got = causal.extended(causal.causal_bars(df(early)), df([*late, *bars("new", [5.0, 6.0], [1, 1], 5)])).orderBy("ticker", "date").collect()
    assert [r["date"] for r in got if r["ticker"] == "a"] == [r["date"] for r in full] and sum(r["ticker"] == "new" for r in got) == 2
    for r, q in zip([r for r in got if r["ticker"] == "a"], full, strict=True):
        assert [r[c] for c in ("open", "high", "low", "close", "volume", "scale", "raw_close", "causal_return")] == pytest.approx([q[c] for c in ("open", "high", "low", "close", "volume", "scale", "raw_close", "causal_return")])
        assert r["close"] * r["volume"] == pytest.approx(r["raw_close"] * r["raw_volume"])
    acts = causal.action_events(causal.causal_bars(df(whole))).orderBy("date").collect()
    assert [(r["factor_before"], r["factor_after"], r["corroborated"]) for r in acts] == [(0.25, 0.5, True), (0.5, 1.0, True)]
    with pytest.raises(Exception, match="bridge"):
        causal.extended(causal.causal_bars(df(early)), df(bars("a", [53.5, *closes[4:]], [0.5, 0.5, 1, 1], 3))).collect()
    with pytest.raises(Exception, match="bridge"):
        causal.extended(causal.causal_bars(df(early)), df(bars("a", closes[4:], [0.5, 1, 1], 4))).collect()
    with pytest.raises(Exception, match="no positive close"):
        causal.causal_bars(df(bars("a", [0.0], [1]))).collect()


def test_moving_level(spark):
    rows = [("k", i, None if i == 4 else float(i * i % 7)) for i in range(30)]
    level, want = None, {}
    for _, i, x in rows:
        if x is not None:
            level = x if level is None else level + 0.2 * (x - level)
            want[i] = level
    df = spark.createDataFrame(rows, "k string, i int, x double")
    assert {r["i"]: r["level"] for r in events.moving_level(df, ["k"], "i", "x", 0.2).collect()} == pytest.approx(want)
    assert {r["i"]: r["level"] for r in events.moving_level(df, ["k"], "i", "x", 1.0).collect()} == {i: x for _, i, x in rows if x is not None}


def test_rankings_of_a_long_group(spark):
    rng = np.random.default_rng(6)
    rows = [("g" if i % 10 else None, i, float(rng.integers(40)), int(rng.random() < 0.3)) for i in range(3000)] + [("one", 1, 1.0, 1), ("one", 2, None, 0)]
    df = spark.createDataFrame(rows, "g string, k long, s double, y int").repartition(5)
    auc, ap, pr = ({r["g"]: r for r in f.collect()} for f in (metrics.roc_auc(df, "s", "y", "g"), metrics.average_precision(df, "s", "y", "k", "g"), metrics.precision_at_rate(df, "s", "y", "k", "g", 0.2)))
    for g in ("g", None):
        own = [r for r in rows if r[0] == g]
        s, y = np.array([r[2] for r in own]), np.array([r[3] for r in own])
        pos, neg = s[y == 1], s[y == 0]
        assert auc[g]["auc"] == pytest.approx(((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / len(pos) / len(neg))
        order = [r[3] for r in sorted(own, key=lambda r: (-r[2], -r[1]))]
        hits = np.cumsum(order)
        assert ap[g]["average_precision"] == pytest.approx(np.mean([hits[i] / (i + 1) for i, v in enumerate(order) if v]))
        top = order[: int(np.ceil(len(order) * 0.2))]
        assert (pr[g]["precision"], pr[g]["recall"]) == pytest.approx((np.mean(top), sum(top) / sum(order)))
    assert auc["one"]["auc"] is None and auc["one"]["positives"] == 1


def test_screens_of_odd_rows(spark):
    p = spark.createDataFrame([("d", 1.0, 0.0), ("d", 2.0, 0.0), ("e", 1.0, 2.0), ("f", 1.0, 1.0), ("f", 2.0, 3.0), ("f", None, 3.0)], "g string, a double, b double")
    assert {r["g"]: r["correlation"] for r in screens.weighted_correlation(p, "a", "b", "g").collect()} == {"d": None, "e": None, "f": pytest.approx(1.0)}
    b = spark.createDataFrame([("x", D(2024, 1, d), 10.0, 9.99 if d == 2 else 11.0, 9.0, 10.0) for d in range(1, 4)] + [("y", D(2024, 1, 1), 0.0, 1.0, 1.0, 1.0)], "ticker string, date date, open double, high double, low double, close double")
    got = {(r["ticker"], r["date"].day): r for r in screens.enveloped(b, 0.01, 0.5, fail=False).collect()}
    assert got["x", 2]["high"] == 10.0 and got["x", 2]["vendor_high"] == 9.99 and got["x", 2]["repaired"] and not got["x", 1]["repaired"] and not got["x", 2]["fault"] and got["y", 1]["fault"]
    for limits in ((0.0001, 0.5), (0.01, 0.1)):
        with pytest.raises(Exception, match="envelope"):
            screens.enveloped(b.where("ticker = 'x'"), *limits).collect()
    z = spark.createDataFrame([(str(i), D(2024, 1, 1), float(i), 5.0, float(i)) for i in range(120)] + [("n", D(2024, 1, 2), None, None, 1000.0)], "ticker string, date date, x double, flat double, far double")
    s = {r["ticker"]: r for r in screens.train_scaled(z, ["x", "flat", "far"], F.lit(D(2024, 1, 1))).collect()}
    assert s["0"]["x"] == pytest.approx(-59.5 / np.std(np.arange(120))) and s["3"]["flat"] == 0.0 and s["n"]["x"] == 0.0 and not s["n"]["x_known"] and s["n"]["far"] == 5.0
    few = screens.train_scaled(z.where("ticker < '2'"), ["x"], F.lit(D(2024, 1, 1))).where("ticker = '1'").first()
    assert few["x"] == 1.0  # under 100 values nothing is scaled
    bins = screens.rank_bins(z.where("date = '2024-01-01'"), "x", 10).groupBy("bin").count().collect()
    assert {r["bin"]: r["count"] for r in bins} == {i: 12 for i in range(10)} and screens.rank_bins(z.limit(5), "x", 10).count() == 0
    days = spark.createDataFrame([(d, i, 1.0 if i < n else None, 1.0) for d, n in ((D(2024, 1, 1), 10), (D(2024, 1, 2), 10), (D(2024, 1, 3), 4)) for i in range(10)], "date date, i int, return_1d double, close double")
    c = screens.latest_complete_session(days).first()
    assert (c["date"], c["step"], c["observed"], c["threshold"], c["panel_latest_observed"]) == (D(2024, 1, 2), 1, 10, 9, 4)
    ties = spark.createDataFrame([("a", D(2024, 1, 1), 1.0, 5.0, True), ("b", D(2024, 1, 1), 1.0, 5.0, True), ("c", D(2024, 1, 1), 1.0, -1.0, True)], "ticker string, date date, s double, p double, observed boolean")
    assert [r["ticker"] for r in screens.tradeable(ties, "s", "p", -5.0, 10.0, 2).orderBy("place").collect()] == ["b", "a"]
