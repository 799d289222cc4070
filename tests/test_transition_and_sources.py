"""Market transitions, ownership, consensus and chart readers against numpy and small files."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import consensus, edges, transition
from tidemark.sources import readers

D = dt.date
STATE = ["a", "b", "c", "d", "e"]


def market(rng, dates=60, nodes=30):
    rows = []
    for t in range(dates):
        shift = rng.normal() * (3 if t % 9 == 0 else 0.3)
        for i in range(nodes):
            gone = lambda x: None if rng.random() < 0.1 else float(x)
            now = {f: gone(rng.normal()) for f in STATE}
            then = {f"{f}_next": gone((now[f] or 0) + rng.normal() * 0.5 + shift) for f in STATE}
            more = {k: gone(rng.normal()) for k in ("path", "v", "v_next", "w", "w_next", "m", "m_next")}
            rows.append({"date": D(2024, 1, 1) + dt.timedelta(t), "ticker": str(i)} | now | then | more)
    for i in range(10):  # a date with too few entities
        rows.append({k: (D(2025, 1, 1) if k == "date" else str(i) if k == "ticker" else 0.5) for k in rows[0]})
    return rows


def components_of(rows, least=20):
    get = lambda k: np.array([np.nan if r[k] is None else r[k] for r in rows])
    keep = lambda x: x[np.isfinite(x)]
    med = lambda x, f=np.median: float(f(keep(x))) if len(keep(x)) >= least else None
    q75 = lambda x: np.quantile(x, 0.75)
    p = get("path")
    delta = np.column_stack([get(f"{f}_next") - get(f) for f in STATE])
    counts = np.isfinite(delta).sum(1)
    energy = np.where(counts >= 3, np.sqrt(np.nansum(delta**2, 1) / np.maximum(counts, 1)), np.nan)
    centres = np.array([med(delta[:, i]) if med(delta[:, i]) is not None else np.nan for i in range(len(STATE))])
    usable = keep(centres)
    out = {"median_return": med(p), "median_absolute_return": med(abs(p)), "q75_absolute_return": med(abs(p), q75), "return_breadth": med(np.sign(p), np.mean)}
    out["robust_return_coherence"] = None if out["median_return"] is None else float(np.clip(out["median_return"] / out["median_absolute_return"], -1, 1))
    for name, k in (("volume", "v"), ("value", "w")):
        y = get(k + "_next")
        out |= {f"{name}_median_z": med(y), f"{name}_q75_z": med(y, q75), f"{name}_participation_z1": med(y, lambda x: np.mean(x >= 1)), f"{name}_delta_median_z": med(y - get(k))}
    common = float(np.sqrt(np.mean(usable**2))) if len(usable) else None
    total = float(np.sqrt(np.nanmean(delta**2)))
    out |= {"common_state_energy": common, "node_state_median_energy": med(energy), "node_state_q75_energy": med(energy, q75), "state_change_participation": med(energy, lambda x: np.mean(x >= 0.75)), "state_feature_breadth": float(np.mean(abs(usable) >= 0.25)) if len(usable) else None}
    level, before = med(get("m_next")), med(get("m"))
    return out | {"market_corr_level": level, "market_corr_change": None if level is None else level - before, "state_coherence": None if common is None else common / total}


def test_transitions_are_numpy(spark):
    rows = market(np.random.default_rng(1))
    schema = "date date, ticker string, " + ", ".join(f"{k} double" for k in rows[0] if k not in ("date", "ticker"))
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema).repartition(4)
    comp = transition.components(df, STATE, "path", "v", "w", "m")
    got = {r["date"]: r.asDict() for r in comp.collect()}
    want = {d: components_of([r for r in rows if r["date"] == d]) for d in {r["date"] for r in rows}}
    for d, w in want.items():
        for c in transition.COMPONENTS:
            assert got[d][c] is None if w[c] is None else got[d][c] == pytest.approx(w[c]), (d, c)
    assert got[D(2025, 1, 1)]["observed_nodes"] == 0 and got[D(2025, 1, 1)]["median_return"] is None
    fit = comp.where(F.col("date") < "2024-02-10")
    cal = transition.calibration(fit)
    lab = {r["date"]: r for r in transition.labelled(comp, cal).collect()}
    mag = lambda c, w: None if w[c] is None else abs(w[c]) if c in transition.SIGNLESS else max(w[c], 0)
    known = [w for d, w in want.items() if d < D(2024, 2, 10)]
    centre, scale = {}, {}
    for c in transition.COMPONENTS:
        x = np.array([mag(c, w) for w in known if w[c] is not None])
        centre[c] = np.median(x)
        scale[c] = np.quantile(x, 0.9) - centre[c] if np.quantile(x, 0.9) - centre[c] > 1e-12 else x.std() or 1.0
    family = lambda f, w: None if any(w[c] is None for c in transition.FAMILIES[f]) else float(np.sqrt(np.mean([np.clip((mag(c, w) - centre[c]) / scale[c], 0, 20) ** 2 for c in transition.FAMILIES[f]])))
    threshold = {f: np.quantile([family(f, w) for w in known if family(f, w) is not None], 0.95) for f in transition.FAMILIES}
    low = {c: np.quantile([w[c] for w in known if w[c] is not None], 0.1) for c in ("median_return", "return_breadth")}
    for d, w in want.items():
        if d == D(2025, 1, 1):
            assert lab[d]["systemic_impact"] is None and not lab[d]["systemic_event"]
            continue
        sell = w["median_return"] <= low["median_return"] and w["return_breadth"] <= low["return_breadth"]
        events = {f: family(f, w) is not None and family(f, w) >= threshold[f] for f in transition.FAMILIES}
        assert lab[d]["broad_selloff"] == sell and {f: lab[d][transition.EVENTS[f]] for f in events} == events
        if any(family(f, w) is None for f in events):
            assert lab[d]["systemic_impact"] is None
            continue
        assert lab[d]["systemic_impact"] == pytest.approx(max(*[family(f, w) / threshold[f] for f in events], float(sell)))
    with pytest.raises(Exception, match="fewer than twenty"):
        transition.calibration(comp.where(F.col("date") < "2024-01-10")).collect()


def test_ownership_is_known_from_its_session_on(spark):
    filings = [("h", "t", D(2024, 1, 2), "20.5"), ("h", "t", D(2024, 1, 6), "1,030"), ("h", "t", D(2024, 1, 7), "5"), ("h", "t", D(2024, 1, 7), "7"), ("h", "t", D(2024, 2, 1), "50"), ("h", "h", D(2024, 1, 2), "9"), ("h", "u", D(2024, 1, 2), "0.4"), ("h", "v", D(2024, 1, 2), "x"), ("h", "w", D(2024, 1, 2), "-3"), ("k", "t", D(2024, 1, 9), "30")]
    s = spark.createDataFrame([(D(2024, 1, d),) for d in (1, 3, 8, 10)], "date date")
    stakes = edges.ownership_stakes(spark.createDataFrame(filings, "holder string, target string, date date, ratio string"), s)
    assert sorted(tuple(r) for r in stakes.collect()) == [("h", "t", 0.07, D(2024, 1, 8), None), ("h", "t", 0.205, D(2024, 1, 3), D(2024, 1, 8)), ("k", "t", 0.3, D(2024, 1, 10), None)]
    on = lambda d: sorted(tuple(r) for r in edges.ownership_edges(stakes, F.lit(D(2024, 1, d)), 0.5).collect())
    assert on(1) == [] and on(3) == [("h", "t", 0.1025), ("t", "h", 0.1025)] and len(on(10)) == 4
    u = edges.edge_union(edges.ownership_edges(stakes, F.lit(D(2024, 1, 3)), 0.5), spark.createDataFrame([("h", "t", 0.10244), ("a", "b", 0.00004)], "src string, dst string, weight double")).collect()
    assert [tuple(r) for r in u] == [("a", "b", 0.0), ("h", "t", 0.1024), ("h", "t", 0.1025), ("t", "h", 0.1025)] or [r["weight"] for r in u][1:] == [0.1024, 0.1024, 0.1024]


def test_consensus_masks_and_demands_equal_sessions(spark):
    days = [D(2024, 1, 1) + dt.timedelta(i) for i in range(15)]
    a = [("x", d, 10.0 + i, 100.0) for i, d in enumerate(days)]
    b = [("x", d, (10.0 + i) * (1.01 if i == 5 else 1), 5.0 + i, 100.0 if i != 7 else 200.0) for i, d in enumerate(days)]
    df = lambda rows, more="": spark.createDataFrame(rows, f"ticker string, date date, close double, {more}volume double")
    got = {r["date"]: r for r in consensus.consensus(df(a), df(b, "adjusted_close double, "), least=10).collect()}
    at = [got[d] for d in days]
    assert [r["return_valid"] for r in at] == [i not in (0, 5, 6) for i in range(15)] and at[2]["log_return"] == pytest.approx(np.log(7 / 6))
    assert not at[7]["volume_valid"] and at[10]["volume_observations"] == 9 and at[10]["volume_shock"] is None and at[11]["volume_shock"] == pytest.approx(0.0)
    with pytest.raises(Exception, match="sessions of the sources differ"):
        consensus.consensus(df(a[1:]), df(b, "adjusted_close double, ")).collect()


def chart(times, **change):
    quote = {k: [1.0 + i for i in range(len(times))] for k in ("open", "high", "low", "close", "volume")} | change
    return json.dumps({"chart": {"error": None, "result": [{"meta": {"symbol": "Q", "exchangeTimezoneName": "America/New_York"}, "timestamp": times, "indicators": {"quote": [quote], "adjclose": [{"adjclose": [0.5 * (1 + i) for i in range(len(times))]}]}}]}})


def test_chart_json(spark, tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text)
    put("a.json", chart([1704205800, 1704292200]))  # 9:30 in New York
    rows = readers.chart_json(spark, str(tmp_path / "a.json"), "America/New_York").orderBy("date").collect()
    assert [(r["symbol"], r["date"], r["close"], r["adjusted_close"], r["adjustment_factor"]) for r in rows] == [("Q", D(2024, 1, 2), 1.0, 0.5, 0.5), ("Q", D(2024, 1, 3), 2.0, 1.0, 0.5)]
    put("none.json", chart([]))
    assert readers.chart_json(spark, str(tmp_path / "none.json"), "America/New_York").count() == 0
    for name, text, match in (("b", chart([1704205800, 1704205801]), "repeated date"), ("c", chart([1704205800], close=[1.0, 2.0]), "missing values"), ("d", chart([1704205800], close=[None]), "missing values"), ("e", '{"chart": {"error": "x", "result": []}}', "no single chart"), ("f", "nothing", "no single chart")):
        put(f"{name}.json", text)
        with pytest.raises(Exception, match=match):
            readers.chart_json(spark, str(tmp_path / f"{name}.json"), "America/New_York").collect()
    with pytest.raises(Exception, match="another zone"):
        readers.chart_json(spark, str(tmp_path / "a.json"), "Asia/Seoul").collect()


def test_chart_xml(spark, tmp_path):
    def put(name, items, count=None, frame="day"):
        body = "".join(f'<item data="{i}" />' for i in items)
        text = f'<?xml version="1.0" encoding="EUC-KR" ?>\n<protocol><chartdata symbol="5930" name="삼성" count="{len(items) if count is None else count}" timeframe="{frame}">{body}</chartdata></protocol>'
        (tmp_path / name).write_bytes(text.encode("euc-kr"))
        return readers.chart_xml(spark, str(tmp_path / name))

    rows = put("a.xml", ["20240103|3|4|2|4|70", "20240102|1|2|1|2|50"]).orderBy("date").collect()
    assert [tuple(r) for r in rows] == [("005930", "삼성", D(2024, 1, 2), 1, 2, 1, 2, 50, None), ("005930", "삼성", D(2024, 1, 3), 3, 4, 2, 4, 70, 1.0)]
    for i, bad in enumerate((["20240102|1|2|1|2"], ["20240102|1|2|1|2|x"], ["20240102|1|2|1|2|5"] * 2, [])):
        with pytest.raises(Exception, match="broken chart"):
            put(f"b{i}.xml", bad).collect()
    for kw in ({"count": 5}, {"frame": "week"}):
        with pytest.raises(Exception, match="broken chart"):
            put("c.xml", ["20240102|1|2|1|2|5"], **kw).collect()


def test_json_lines_of_a_universe(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"t": "1", "x": 1}\n\n{"x": 1, "t": "1"}\n{"t": "2", "x": 1}\nnope\n[1]\n{"t": "3"}\n')
    members = spark.createDataFrame([("1",), ("3",)], "ticker string")
    rows, counters = readers.json_lines_of(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "absent.jsonl")], "t string, x int", "t", members)
    assert sorted((r["t"], r["x"]) for r in rows.collect()) == [("1", 1), ("3", None)]
    assert counters.first().asDict() == {"lines": 7, "empty_lines": 1, "invalid_lines": 2, "outside": 1, "repeated": 1}
    assert readers.json_lines_of(spark, [str(tmp_path / "absent.jsonl")], "t string", "t", members)[0].count() == 0


def test_csv_bars_and_a_table_that_is_never_revised(spark, tmp_path):
    (tmp_path / "005930_2020_2024.csv").write_text("date,open,high,low,close,volume\n2024-01-02,0.1,0.30000000000000004,0.1,0.2,5\n")
    (r,) = readers.ohlcv_csv(spark, str(tmp_path / "*.csv")).collect()
    assert (r["ticker"], r["date"], r["high"], r["volume"]) == ("005930", D(2024, 1, 2), 0.30000000000000004, 5.0)
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, x int")
    readers.write_once(df, str(tmp_path / "release"), ["k"])
    back = spark.read.parquet(str(tmp_path / "release"))
    assert sorted(back.columns) == ["k", "record_sha256", "x"] and back.select("record_sha256").distinct().count() == 2
    with pytest.raises(Exception, match="(?i)already exists|path_already_exists"):
        readers.write_once(df, str(tmp_path / "release"))
    same = readers.merge_releases(df, spark.createDataFrame([("b", 2), ("c", 3)], "k string, x int"), ["k"])
    assert same.count() == 3
    with pytest.raises(Exception, match="conflicting rows"):
        readers.merge_releases(df, spark.createDataFrame([("b", 9)], "k string, x int"), ["k"]).collect()
