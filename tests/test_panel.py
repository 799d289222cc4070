import datetime
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, backtest, events, metrics, panel, relational

D0 = datetime.date(2020, 1, 1)


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(1)
    rows = []
    for t in range(6):
        p = 100.0
        for i in range(90):
            o, p = p, p * (1 + rng.normal(0, 0.02))
            if (t, i) == (2, 40):
                continue  # a session that is missing
            if (t, i) == (3, 41):
                o = p = 50.0
                rows.append((f"t{t}", D0 + datetime.timedelta(i), p, p, p, p, 0.0))  # flat and without volume
                continue
            rows.append((f"t{t}", D0 + datetime.timedelta(i), o, max(o, p) * 1.01, min(o, p) * 0.99, p, float(rng.integers(1, 100))))
    return spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double")


def frame(df):
    return df.toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)


def test_densify_carries_closes_and_marks_absent_rows(bars):
    d = frame(panel.densify(bars))
    assert len(d) == 6 * 90
    gap = d[(d.ticker == "t2") & (d.date == D0 + datetime.timedelta(40))].iloc[0]
    before = d[(d.ticker == "t2") & (d.date == D0 + datetime.timedelta(39))].iloc[0]
    assert not gap.observed and pd.isna(gap.close) and gap.execution_close == before.close and gap.volume == 0
    halted = d[(d.ticker == "t3") & (d.date == D0 + datetime.timedelta(41))].iloc[0]
    assert not halted.observed and pd.isna(halted.close)


def test_features_match_pandas(bars):
    d = frame(panel.price_features(panel.densify(bars)))
    for _, g in d.groupby("ticker"):
        r = (g.close / g.close.shift(1) - 1).where(g.close.notna() & g.close.shift(1).notna())
        for name, want in (
            ("return_1d", r),
            ("volatility_20d", r.rolling(20).std()),
            ("ma10_gap", g.close / g.close.rolling(10).mean() - 1),
            ("volume_z20", (np.log1p(g.volume) - np.log1p(g.volume).rolling(20).mean()) / np.log1p(g.volume).rolling(20).std()),
            ("drawdown_20d", g.close / g.close.rolling(20).max() - 1),
        ):
            assert np.allclose(g[name].astype(float), want.astype(float), equal_nan=True, atol=1e-9), name


def test_features_do_not_see_the_future(bars):
    cut = D0 + datetime.timedelta(60)
    changed = bars.withColumn("close", F.when(F.col("date") > F.lit(cut), F.col("close") * 3).otherwise(F.col("close"))).withColumn("high", F.when(F.col("date") > F.lit(cut), F.col("high") * 4).otherwise(F.col("high")))
    low = ["return_5d", "ma20_gap", "volatility_10d", "drawdown_20d"]
    a, b = (frame(panel.price_features(panel.densify(x)).where(F.col("date") <= F.lit(cut)).select("ticker", "date", *low)) for x in (bars, changed))
    pd.testing.assert_frame_equal(a, b)


def test_average_rank_and_zscore(spark):
    df = spark.createDataFrame([(D0, "a", 1.0), (D0, "b", 1.0), (D0, "c", 3.0), (D0, "d", None)], "date date, ticker string, x double")
    got = {r["ticker"]: r for r in panel.cross_section(df, "x").collect()}
    assert set(got) == {"a", "b", "c"}
    assert math.isclose(got["a"]["cs_rank"], 1.5 / 3 - 0.5) and math.isclose(got["c"]["cs_rank"], 0.5)
    assert math.isclose(got["c"]["cs_z"], (3 - 5 / 3) / np.std([1, 1, 3]))


def test_asof_both_ways(spark):
    left = spark.createDataFrame([(1, 5), (1, 7), (2, 1), (None, 3)], "k int, t int")
    right = spark.createDataFrame([(1, 5, "a"), (1, 6, "b"), (2, 2, "c")], "k int, u int, v string")
    back = {(r["k"], r["t"]): r["r_v"] for r in asof.asof_backward(left, right, ["k"], "t", "u").collect()}
    assert back == {(1, 5): "a", (1, 7): "b", (2, 1): None, (None, 3): None}
    strict = {(r["k"], r["t"]): r["r_v"] for r in asof.asof_backward(left, right, ["k"], "t", "u", strict=True).collect()}
    assert strict[(1, 5)] is None
    ahead = {(r["k"], r["t"]): r["r_v"] for r in asof.asof_forward(left, right, ["k"], "t", "u").collect()}
    assert ahead == {(1, 5): "a", (1, 7): None, (2, 1): "c", (None, 3): None}


def test_intervals_are_half_open(spark):
    points = spark.createDataFrame([(1, 1), (1, 3), (1, 5), (2, 2)], "k int, t int")
    spans = spark.createDataFrame([(1, 1, 3), (1, 2, 5)], "k int, s int, e int")
    got = {(r["k"], r["t"]): r["covered"] for r in asof.within_intervals(points, spans, ["k"], "t", "s", "e").collect()}
    assert got == {(1, 1): True, (1, 3): True, (1, 5): False, (2, 2): False}


def test_auc_with_ties_and_newey_west(spark):
    df = spark.createDataFrame([("g", 1.0, 0), ("g", 1.0, 1), ("g", 2.0, 1), ("g", 0.0, 0)], "grp string, s double, y int")
    assert math.isclose(metrics.roc_auc(df, "s", "y", "grp").first()["auc"], (0.5 + 1 + 1 + 1) / 4)
    x = [0.1, 0.3, -0.2, 0.4, 0.2]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(x)], "series string, i int, x double")
    c = np.array(x) - np.mean(x)
    var = (c @ c + 2 * 0.5 * (c[1:] @ c[:-1])) / 5
    assert math.isclose(metrics.newey_west(df, "x", "i", 1).first()["t_value"], np.mean(x) / math.sqrt(var / 5))


def test_stop_or_take_takes_the_first_hit(spark):
    closes = [10.0, 10.0, 10.2, 9.0, 12.0, 12.0]
    rows = [("a", D0 + datetime.timedelta(i), 10.0, c) for i, c in enumerate(closes)]
    df = spark.createDataFrame(rows, "ticker string, date date, open double, close double")
    got = backtest.stop_or_take(df, 0.05, 0.15, 4).orderBy("date").collect()
    assert got[0]["exit_day"] == 3 and math.isclose(got[0]["exit_return"], -0.1)
    assert len(got) == 2


def test_rolling_actives_counts_distinct_members(spark):
    rows = [(datetime.datetime(2020, 1, d), m) for d, m in ((1, "a"), (1, "b"), (2, "a"), (3, "c"), (5, "a"))]
    df = spark.createDataFrame(rows, "ts timestamp, m string")
    got = {r["date"].day: (r["active_1"], r["active_3"]) for r in events.rolling_actives(df, F.col("ts").cast("date"), "m", [1, 3]).collect()}
    assert got == {1: (2, 2), 2: (1, 2), 3: (1, 3), 5: (1, 2)}


def test_conflicts_and_diff(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (2, None)], "k int, v string")
    assert [r["k"] for r in relational.conflicting(df, ["k"]).collect()] == [2]
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert {(r["k"], r["side"]) for r in relational.row_diff(a, b, ["k"]).collect()} == {(1, "left"), (2, "both"), (3, "right")}


def test_empty_tables(bars):
    none = bars.limit(0)
    assert panel.densify(none).count() == 0
    assert panel.price_features(panel.densify(none)).count() == 0
    assert backtest.top_k(none, "close", 3).count() == 0
