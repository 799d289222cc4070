"""Queries on small odd tables, against their SQL."""

import datetime as dt
import random
from difflib import SequenceMatcher
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import aliases, gram, titles
from tidemark.operators.events import with_decay
from tidemark.plans.panel_queries import half6


def rows_of(spark, folder, name, **tables):
    """Rows of a query and of its SQL on the given tables, columns by name, without rounding."""
    con = duckdb.connect()
    for table, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    df = entry.queries()[name](spark, str(folder))
    columns = sorted(df.columns)
    plain = lambda r: tuple(str(x) for x in r)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    return sorted(plain(r) for r in df.select(columns).collect()), sorted(plain(r) for r in want)


def test_clean_html_keeps_references_that_are_cut(spark, tmp_path):
    html = ["<title>a &amp;&amp;&am</title>x&amp y", "b &amp;lt; &lt;i&gt; &#39;q&#39; &notit; &amp", "&&amp;amp;&nbsp;<b>c</b>", None]
    got, want = rows_of(spark, tmp_path, "clean_html", pages={"page_id": [1, 2, 3, 4], "url": ["u"] * 4, "html": html})
    assert got == want


def test_lifecycle_universe_ties_go_by_market(spark, tmp_path):
    day = dt.datetime(1996, 1, 2)
    markets = ["4-NOT SPECIFIED", "3-MEDIUM", "1-URGENT", "5-LOW", "2-HIGH", "1-URGENT"]
    orders = {"o_orderkey": [*range(60)], "o_custkey": [i // 6 for i in range(60)], "o_orderpriority": markets * 10, "o_orderdate": [day] * 60}
    got, want = rows_of(spark, tmp_path, "lifecycle_universe", orders=orders)
    assert got == want and len(got) == 10


def test_session_gaps_count_whole_seconds(spark, tmp_path):
    at = lambda s, us: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s, microseconds=us)
    ts = [at(0, 900_000), at(14401, 100_000), at(28801, 900_000), at(50000, 0), None, at(7, 0)]
    got, want = rows_of(spark, tmp_path, "session_gaps", events={"event_id": [1, 2, 3, 4, 5, 6], "user_id": [1, 1, 1, 1, 1, 2], "ts": ts, "value": [1.5, 2.0, 3.0, 4.0, 5.0, 6.0]})
    assert got == want


def test_event_frames_round_once(spark, tmp_path):
    days = [dt.datetime(2024, 1, d, 12) for d in (1, 2, 3, 4)]
    events = {"event_id": [53, 60, 61, 62], "user_id": [7, 8, 8, 8], "ts": days, "event_type": ["click"] * 4, "value": [29.27, 3.0, 4.0, 5.0], "props": ['{"k": 84}'] * 4}
    got, want = rows_of(spark, tmp_path, "event_frames", events=events)
    assert got == want and len(got) == 8


def test_decay_in_lanes_keeps_halves(spark):
    values = [0.0077625, 0.1234565, 0.7, 1.9999995]
    rows = [(k, t, x if t in (1, 2503) else 0.0) for k, x in enumerate(values) for t in range(2510)]
    d = with_decay(spark.createDataFrame(rows, "k int, t int, x double"), ["k"], "t", {"x": "y"}, 5.0, lanes=True)
    got = {(r["k"], r["t"]): r["y"] for r in d.where("t in (0, 1, 3, 6, 11, 2503)").collect()}
    for k, x in enumerate(values):
        assert [got[k, t] for t in (0, 1, 6, 11, 2503)] == [0.0, x, x / 2, x / 4, x]
        assert abs(got[k, 3] - x * 0.5**0.4) < 1e-15


def test_half6_rounds_the_product(spark):
    values = [0.00776249999999999995, 0.0077625, 0.5630384999999999, -1.5, 2.6e-7, None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in values], "x double").select(*half6("x")).collect()]
    assert got == [duckdb.execute("select round(?::double, 6)", [x]).fetchone()[0] for x in values]


def test_unlike_titles_with_a_common_word_are_not_matched(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    base = ["the " + " ".join(word() for _ in range(8)) for _ in range(120)]

    def edited(t, n):
        for _ in range(n):
            i = rng.randrange(4, len(t))
            t = t[:i] + rng.choice("abcdefghijklmnop ") * rng.randrange(2) + t[i + rng.randrange(2) :]
        return " ".join(t.split())

    all_titles = list(dict.fromkeys(base + [edited(t, rng.randint(1, 14)) for t in base for _ in range(2)]))
    calls = []
    monkeypatch.setattr(titles, "SequenceMatcher", lambda *x, **k: calls.append(1) or SequenceMatcher(*x, **k))
    row = SimpleNamespace(block=0, other_block=0, keys=[*range(120)], titles=base, words=[t.split() for t in base], other_keys=[*range(120)], other_titles=base, other_words=[t.split() for t in base])
    assert list(titles._near(row)) == [] and len(calls) < 20  # of 7,140 pairs
    monkeypatch.undo()
    monkeypatch.setattr(titles, "BLOCK", 50)
    df = spark.createDataFrame([(i, i % 2, t) for i, t in enumerate(all_titles)], "k long, day long, title string")
    got = {(r["key"], r["other"]): r["ratio"] for r in titles.near_titles(df, "k", "day", "title").collect()}
    want = {}
    runs = lambda t: {t.replace(" ", "")[i : i + 3] for i in range(len(t.replace(" ", "")) - 2)}
    words = lambda t: {w for w in t.split() if len(w) > 1}
    index = lambda t: set(sorted(words(t), key=lambda w: (-len(w), w))[:8])
    share = lambda a, b: len(a & b) / len(a | b)
    for i, x in enumerate(all_titles):
        for j in range(i + 2, len(all_titles), 2):
            y = all_titles[j]
            ratio = SequenceMatcher(None, y, x, autojunk=False).ratio()
            if index(x) & index(y) and (ratio >= 0.9 or ratio >= 0.82 and share(words(x), words(y)) >= 0.55 and share(runs(x), runs(y)) >= 0.68):
                want[i, j] = ratio
    assert got == want and len(want) > 40


def test_aliases_are_looked_for_by_form(spark):
    """A word of Latin letters is looked up among a text's words, others by expression or compact form, with what each means unchanged."""
    text = "the a-b x7 삼성전자는 alpha beta"
    found = {"the": True, "th": False, "a-b": True, "x7": True, "7": False, "b x": False, "b x7": True, "삼성전자": True, "삼성": False, "alpha-beta": True, "phabe": True, "gamma": False}
    df = spark.createDataFrame([(text, a) for a in found], "t string, a string").withColumn("c", aliases.compact(F.col("t"))).withColumn("f", aliases.form(F.col("a")))
    got = {r["a"]: (bool(r["h"]), r["o"]) for r in df.select("a", (F.size(aliases._held_forms("t", "c", F.array("f"))) > 0).alias("h"), aliases.contains(F.col("t"), F.col("c"), F.col("a")).alias("o")).collect()}
    assert got == {a: (x, x) for a, x in found.items()}


def test_edges_that_leave_blocks_grow_with_the_nodes_only(spark, monkeypatch):
    x = np.round(np.abs(np.random.default_rng(5).normal(size=(300, 3))))  # many ties
    left = []
    keep = gram.written
    monkeypatch.setattr(gram, "BLOCK", 7)
    monkeypatch.setattr(gram, "written", lambda df, name: (left.append((name, keep(df, name))), left[-1][1])[1])
    nodes = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "node long, v array<double>")
    got = {(r["src"], r["dst"]): r["weight"] for r in gram.strongest_products(nodes, None, 4, 0.05, "positive").collect()}
    w = x @ x.T
    want = {(i, j): w[i, j] for i in range(300) for j in sorted((j for j in range(300) if j != i and w[i, j] >= 0.05), key=lambda j: (w[i, j], j))[-4:]}
    assert got == want
    assert dict(left)["edges"].count() <= 8 * 300 * 4
