"""Names in texts, near titles, leaders, components and the session clock against plain loops."""

import datetime as dt
import random
import re
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import aliases, clock, graph, leaders, titles

D = dt.date
ALIAS = "ticker string, alias string, alias_type string, confidence double, valid_from date, valid_to date"


def held(text, alias):
    small = lambda x: re.sub(r"[^0-9a-z가-힣]+", "", x)
    text, alias = " ".join(text.lower().split()), " ".join(alias.lower().split())
    if re.fullmatch(r"[0-9a-z+&. -]+", alias) and len(small(alias)) <= 4:
        return bool(re.search(r"(?<![0-9a-z])" + re.escape(alias).replace(r"\ ", r"\s+") + r"(?![0-9a-z])", text))
    if re.fullmatch(r"[가-힣]{2,8}", alias):
        return bool(re.search(rf"(?<![0-9a-z가-힣]){alias}(?:{aliases.PARTICLES})?(?=$|[^0-9a-z가-힣])", text))
    return small(alias) in small(text)


def test_alias_matches_are_all_texts_against_all_aliases(spark):
    rng = random.Random(2)
    words = ["LG", "AT&T", "at", "t", "c.j", "삼성전자", "삼성전자가", "삼성", "Global-Foundries", "global", "foundries", "of", "SK", "SKhynix", "카카오는", "카카오", "A+B", "ab", "e-mart", "emart24", "한국전력공사의"]
    names = ["LG", "AT&T", "C.J", "삼성전자", "Global Foundries", "SK", "SK hynix", "카카오", "A+B", "e-mart", "foundries of SK", "한국전력공사", "x", "--", "t"]
    kinds = ["legal_name", "brand", "former_name", "affiliate"]
    day = lambda: None if rng.random() < 0.4 else D(2024, 1, 1) + dt.timedelta(rng.randrange(30))
    reg = list({(rng.choice("pqr"), n, rng.choice(kinds), rng.choice([0.5, 0.9, None]), day(), day()) for n in names for _ in range(3)})
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(12))) if i % 17 else None, day()) for i in range(150)]
    texts.append((999, "<b>AT&amp;T</b> and\n삼성전자에서", None))
    got = aliases.alias_matches(spark.createDataFrame(texts, "id long, text string, day date"), spark.createDataFrame(reg, ALIAS), "id", "text", "day")
    want = {}
    for i, text, d in texts:
        text = "at&t and 삼성전자에서" if i == 999 else text or ""
        for t, n, k, c, a, z in reg:
            if not re.sub(r"[^0-9a-z가-힣]+", "", n.lower()) or not held(text, n) or (d is not None and ((a and d < a) or (z and d > z))):
                continue
            identity = "identity" if k in aliases.IDENTITY else "related_entity"
            rank = (identity == "identity", c or 0.0, len(re.sub(r"[^0-9a-z가-힣]+", "", n.lower())), n)
            if (i, t) not in want or rank > want[i, t][0]:
                want[i, t] = (rank, n, identity, c)
    rows = {(r["id"], r["ticker"]): (r["alias"], r["relationship"]) for r in got.collect()}
    assert rows == {k: v[1:3] for k, v in want.items()} and len(rows) > 100 and any(k[0] == 999 for k in rows)


def test_registry_faults(spark):
    reg = [("p", "Alpha", "legal_name", 0.9, None, None), ("q", "alpha!", "brand", 0.9, None, None), ("p", "Z", "brand", 1.5, D(2024, 2, 1), D(2024, 1, 1)), ("p", "Beta", "nick", None, None, None), ("p", "Beta", "nick", None, None, None)]
    got = {(r["fault"], r["alias"]) for r in aliases.registry_faults(spark.createDataFrame(reg, ALIAS)).collect()}
    assert got == {("ambiguous", "Alpha"), ("ambiguous", "alpha!"), ("too short", "Z"), ("confidence", "Z"), ("validity", "Z"), ("alias_type", "Beta"), ("confidence", "Beta"), ("repeated", "Beta")}


def test_near_titles_are_difflib_on_blocked_pairs(spark):
    rng = random.Random(8)
    vocabulary = [f"word{i}" + "x" * (i % 5) for i in range(40)]
    rows = []
    for i in range(120):
        if i % 3 and rows:
            base = rows[rng.randrange(len(rows))][2].split()
            base[rng.randrange(len(base))] = rng.choice(vocabulary)
            title = " ".join(base)
        else:
            title = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 9)))
        rows.append((i, i % 2, title))
    rows += [(500, 0, "Short"), (501, 0, "short!"), (502, 0, ""), (503, 0, None)]
    df = spark.createDataFrame(rows, "k long, d int, t string")
    got = {(r["key"], r["other"]): r["ratio"] for r in titles.near_titles(df, "k", "d", "t").collect()}
    norm = {i: (d, re.sub(r"[^\w]+", " ", (t or "").lower()).strip()) for i, d, t in rows}
    keys = lambda t: set(sorted({w for w in t.split() if len(w) >= 2}, key=lambda w: (-len(w), w))[:8])
    runs = lambda t: {t.replace(" ", "")[i : i + 3] for i in range(max(1, len(t.replace(" ", "")) - 2))}
    jac = lambda a, b: len(a & b) / len(a | b)
    first, want = {}, {}
    for i in sorted(norm):
        if norm[i][1]:
            first.setdefault(norm[i], i)
    for i, x in norm.items():
        if x[1] and first[x] != i:
            want[first[x], i] = 1.0
    reps = sorted(first.values())
    for a in reps:
        for b in reps:
            (d, x), (e, y) = norm[a], norm[b]
            if a < b and d == e and min(len(x), len(y)) >= 12 and keys(x) & keys(y):
                r = SequenceMatcher(None, y, x, autojunk=False).ratio()
                w = lambda t: {v for v in t.split() if len(v) >= 2}
                if r >= 0.9 or (r >= 0.82 and jac(w(x), w(y)) >= 0.55 and jac(runs(x), runs(y)) >= 0.68):
                    want[a, b] = r
    assert got == want and len(want) > 20
    clusters = {r["key"]: r["cluster"] for r in titles.title_clusters(df, "k", "d", "t").collect()}
    assert len(clusters) == len(rows) and all(clusters[a] == clusters[b] for a, b in want) and clusters[503] == 503


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(30), rng.randrange(30)) for _ in range(15)]
    parent = {x: x for e in links for x in e}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}


def test_leader_clusters_are_the_loop(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 6))
    rows = [(i % 2 if i % 13 else None, i, [float(x) for x in centres[rng.integers(5)] + rng.normal(size=6) * 0.5], ["실적 10 발표", "매출 10 2024", "수주 11", "plain", None][i % 5]) for i in range(120)]
    rows += [(1, 900, None, "a"), (1, 901, [0.0] * 6, "a"), (1, 902, [1.0], "a"), (1, 903, [float("nan")] * 6, "a")]
    df = spark.createDataFrame(rows, "g int, k long, v array<double>, t string").repartition(3)
    got = {r["k"]: (r["leader"], round(r["similarity"], 4)) for r in leaders.leader_clusters(df, ["g"], [F.desc("k")], "k", "v", "t", 0.8).collect()}
    want, led = {}, {}
    for g, k, v, t in sorted(rows, key=lambda r: -r[1]):
        v = np.asarray(v if v is not None else [0.0], dtype=np.float32)
        if len(v) != 6 or not np.isfinite(v).all() or not v.any():
            want[k] = (k, 1.0)
            continue
        v = v / np.linalg.norm(v)
        best = None
        for k2, v2, t2 in led.setdefault(g, []):
            s = float(v @ v2)
            if s >= 0.8 and leaders.compatible(leaders.marks(t), leaders.marks(t2)) and (best is None or s > best[1]):
                best = (k2, s)
        if best is None:
            led[g].append((k, v, t))
            best = (k, 1.0)
        want[k] = (best[0], round(best[1], 4))
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 2e-4 for k in want) and len({v[0] for v in want.values()}) < 110


def test_titles_that_may_be_alike():
    m = leaders.marks
    assert m("2024 profit 1.5 and 30") == ({"1.5", "30"}, set()) and m("영업이익 3") == ({"3"}, {"earnings"})
    assert not leaders.compatible(m("up 3"), m("up 4")) and leaders.compatible(m("up 3"), m("up 3 4")) and not leaders.compatible(m("파업"), m("소송"))


def test_clock_over_daylight_saving_and_half_days(spark):
    days = [D(2024, 3, 8), D(2024, 3, 11), D(2024, 11, 1), D(2024, 11, 4), D(2024, 11, 29), D(2024, 12, 2)]
    s = clock.session_table(spark.createDataFrame([(d,) for d in days], "date date"), "America/New_York", half_days=F.col("date") == "2024-11-29").orderBy("date")
    rows = s.collect()
    at = lambda *x: dt.datetime(*x)
    assert [r["open_utc"] for r in rows] == [at(2024, 3, 8, 14, 30), at(2024, 3, 11, 13, 30), at(2024, 11, 1, 13, 30), at(2024, 11, 4, 14, 30), at(2024, 11, 29, 14, 30), at(2024, 12, 2, 14, 30)]
    assert rows[4]["close_utc"] == at(2024, 11, 29, 18, 0) and rows[0]["final_close_utc"] == at(2024, 3, 11, 20, 0) and rows[5]["final_date"] is None
    bars = [
        (1, at(2024, 11, 29, 14, 30), D(2024, 11, 29)), (2, at(2024, 11, 29, 18, 0), D(2024, 11, 29)), (3, at(2024, 11, 29, 18, 1), D(2024, 11, 29)), (4, at(2024, 11, 29, 9, 0), D(2024, 11, 29)),
        (5, at(2024, 11, 30, 1, 0), D(2024, 11, 29)), (6, at(2024, 11, 29, 15, 0), D(2024, 12, 2)), (7, at(2024, 12, 1, 23, 0), D(2024, 12, 2)), (8, at(2024, 12, 1, 15, 0), D(2024, 12, 1)), (9, at(2024, 3, 11, 8, 10), D(2024, 3, 11)), (10, at(2024, 3, 8, 8, 10), D(2024, 3, 8)),
    ]
    p = clock.phased(spark.createDataFrame(bars, "id int, at timestamp_ntz, day date"), s, "America/New_York", "at", "day", 30)
    got = {r["id"]: (r["phase"], r["bucket"], r["conflict"]) for r in p.collect()}
    assert got == {
        1: ("regular", "regular:0000", False), 2: ("regular", "regular:0007", False), 3: ("after_hours", "after_hours:0000", False), 4: ("premarket", "premarket:0000", False), 5: ("overnight", "overnight:0040", False),
        6: (None, None, True), 7: ("overnight", "overnight:0036", False), 8: (None, None, False), 9: ("premarket", "premarket:0000", False), 10: ("overnight", "overnight:0006", False),
    }
    daily = spark.createDataFrame([("a", d, float(i)) for i, d in enumerate(days)], "ticker string, date date, x double")
    a = clock.daily_available(daily, s, "date", 900)
    cut = lambda *x: clock.latest_available(a, ["ticker"], "date", F.lit(at(*x)).cast("timestamp_ntz")).collect()
    assert cut(2024, 12, 2, 21, 15)[0]["date"] == D(2024, 11, 29) and cut(2024, 12, 2, 21, 14)[0]["date"] == D(2024, 11, 4) and cut(2024, 3, 11, 20, 14) == []
    assert spark.range(1).select(clock.bar_available(F.lit(at(2024, 1, 1, 9, 0)), 5, 15).alias("t")).first()["t"] == at(2024, 1, 1, 9, 5, 15)
