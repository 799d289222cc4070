"""Operators 11 to 13 against plain Python, with hot keys over several tasks and odd input."""

import hashlib
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives as hn
from tidemark.llm import line_dedup, prefix_trie, scans

ROW = "doc_id long, text string, lines string, _row int, n_lines int"


@pytest.fixture()
def small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    yield
    spark.conf.set(key, before)


def brute_lines(docs, least, enough):
    white = " \t\n\v\f\r"
    holders = defaultdict(set)

    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(white))

    rank = lambda d: (d is not None, d or 0)
    for d, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(d)
    out = []
    for d, text in docs:
        lines = (text or "").split("\n")
        keep = [x for x in lines if len(holders[key(x)]) < enough or d == max(holders[key(x)], key=rank)]
        out.append((d, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def test_line_dedup_is_brute_force(spark, small_batches):
    rng = random.Random(5)
    pool = [f"{'xy' if i % 2 else 'Éa'}{i} " + "word " * (i % 4) for i in range(12)]
    docs = []
    for i in range(160):
        lines = [rng.choice(pool) for _ in range(rng.randrange(4))] + (["  The HOT line everyone has\t"] * rng.randrange(1, 3) if i % 3 else [])
        docs.append((i if i % 20 else None, "\n".join(lines) if i % 15 else rng.choice([None, "", "\n\n"])))
    docs += docs[:9] + [(3, "the hot line everyone has\nother")]
    df = spark.createDataFrame([(d, t, "kept", 7, 1) for d, t in docs], ROW).repartition(5)
    got = line_dedup.without_shared_lines(df, least=8, enough=5)
    assert got.columns == ["doc_id", "text", "lines_", "_row", "n_lines", "lines"]
    rows = sorted([(r["doc_id"], r["lines"]["n_lines"], r["lines"]["n_dropped"], r["text"]) for r in got.collect()], key=str)
    assert rows == brute_lines(docs, 8, 5)
    assert {(r["lines_"], r["_row"], r["n_lines"]) for r in got.collect()} == {("kept", 7, 1)}


def test_line_bitmaps_hold_no_text_and_empty_tables_give_none(spark):
    docs = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    row = line_dedup.keep_bitmaps(docs).first()
    assert row["n_lines"] == 2 and row["n_dropped"] == 0 and line_dedup.kept_lines("a\nb", row["keep"]) == "a\nb"
    assert line_dedup.without_shared_lines(docs.limit(0)).count() == 0
    assert line_dedup.kept_lines("a\nb\nc", line_dedup.pack_bits(3, [1])) == "a\nc"


@pytest.mark.parametrize("seed", range(6))
def test_verdicts_over_any_cuts(seed):
    """Rows of sorted hashes, cut into tasks and batches anywhere."""
    import pyarrow as pa

    rng = random.Random(seed)
    rows = sorted({(rng.choice([1, 2, 2, 2, 3, 4]), 0, False, -rng.randrange(9 if rng.random() < 0.5 else 3), 0, rng.randrange(3)) for _ in range(80)})
    docs = defaultdict(set)
    for h, _, _, d, *_ in rows:
        docs[h].add(-d)
    want = sorted((h, -d, p) for h, _, _, d, _, p in rows if len(docs[h]) >= 5 and -d != max(docs[h]))

    def batch(rs):
        cols = list(zip(*rs, strict=True))
        data = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.bool_()), pa.array([-d for d in cols[3]], pa.int64()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.int32())]
        return pa.RecordBatch.from_arrays(data, names=["h1", "h2", "no_id", "doc_id", "text_id", "pos"])

    found, at, part = [], 0, 0
    while at < len(rows):
        v, end = line_dedup.Verdicts(part, 5), min(len(rows), at + rng.randrange(1, 40))
        while at < end:
            n = min(end - at, rng.randrange(1, 9))
            for b in v.feed(batch(rows[at : at + n])):
                found += b.to_pylist()
            at += n
        for b in v.close(True):
            found += b.to_pylist()
        part += 1
    known = {(h1, h2): (many, top) for h1, h2, many, top, _ in line_dedup.resolved([r for r in found if r["kind"] == line_dedup.SUMMARY], 5)}
    got = [(r["h1"], r["doc_id"], r["pos"]) for r in found if r["kind"] == line_dedup.DROPPED]
    got += [(r["h1"], r["doc_id"], r["pos"]) for r in found if r["kind"] == line_dedup.OPEN and known[r["h1"], r["h2"]][0] and known[r["h1"], r["h2"]][1] != r["doc_id"]]
    assert sorted(got) == want


def test_prefix_sums_of_a_key_over_several_tasks(spark, small_batches):
    rng = random.Random(1)
    rows = [(7 if i % 3 else i % 5, i, rng.randrange(-(1 << 62), 1 << 62)) for i in range(150)]
    df = spark.createDataFrame(rows, "k long, i long, x long").repartition(3)
    got = {r["i"]: r for r in scans.prefix_sums(df, "k", ["i"], "x", prefix_trie.BASE).collect()}
    seen = defaultdict(lambda: (0, 0))
    for k, i, x in sorted(rows):
        n, total = seen[k]
        after = (total + x * pow(prefix_trie.BASE, n, 1 << 64)) % (1 << 64)
        r = got[i]
        assert (r["place"], r["before"] % (1 << 64), r["upto"] % (1 << 64)) == (n, total, after)
        seen[k] = n + 1, after
    assert scans.prefix_sums(df.limit(0), "k", ["i"], "x").count() == 0


def test_joined_digests(spark, small_batches):
    rows = [(i % 3 and 1, i * 7919 % 1000) for i in range(400)]
    got = {r["k"]: r["digest"] for r in scans.joined_digests(spark.createDataFrame(rows, "k long, v long"), ["k"], "v", size=20).collect()}
    for k in (0, 1):
        assert got[k] == hashlib.sha256(",".join(str(v) for v in sorted(v for a, v in rows if a == k)).encode()).hexdigest()


def brute_negatives(rows, scale, anchors):
    ok = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or x != x or abs(x) == float("inf") for x in v):
            continue
        parts = [max(-(1 << 63), min((1 << 63) - 1, (Fraction(x) * scale).__floor__())) for x in v]
        ok[i] = min(ok.get(i, (label, parts)), (label, parts))
    out = []
    limit = (1 << 63) - 1
    for a, (label, v) in ok.items():
        if a % anchors:
            continue
        s = {i: max(-limit, min(limit, sum(x * y for x, y in zip(v, w, strict=False)))) for i, (_, w) in ok.items() if i != a}
        order = sorted(s, key=lambda i: (-s[i], i))
        for p in [i for i in order if ok[i][0] == label][:5]:
            hit = [i for i in order if ok[i][0] != label and 50 * s[p] <= 100 * s[i] <= 95 * s[p]][:3]
            out += [(a, p, r, n, s[p], s[n]) for r, n in enumerate(hit, 1)]
    return sorted(out)


def test_hard_negatives_are_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK", 20)
    monkeypatch.setattr(hn, "ANCHORS", 4)
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(3)), [float(x) for x in np.round(rng.normal(size=3) + 1, 1)]) for i in range(90)]
    rows += [(None, 1, [1.0, 1.0, 1.0]), (200, None, [1.0, 1.0, 1.0]), (205, 1, None), (210, 1, [1.0, None, 1.0]), (215, 1, [float("nan"), 1.0, 1.0]), (220, 0, [float("inf"), 0.0, 0.0])]
    rows += [(225, 1, []), (230, 2, [5.0]), (5, 0, [0.1, 0.1, 0.1]), rows[7], (235, 0, [1e300, 1.0, 1.0]), (240, 1, [9e14, 1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"parts": F.lit(1), "block": F.lit("x"), "score": F.lit(2), "row": F.lit(0)})
    got = hn.hard_negatives(hn.integer_rows(df, F.col("embedding"), 256), F.col("vec_id") % 5 == 0)
    assert sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == brute_negatives(rows, 256, 5)
    assert hn.hard_negatives(hn.integer_rows(df.limit(0), F.col("embedding"), 256), F.col("vec_id") % 5 == 0).count() == 0


def brute_trie(turns, base, head):
    convs = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v, key=lambda x: x[0])] for c, v in convs.items()}
    built = {c: own.get(base(c), [])[: head(c)] + v[head(c) :] for c, v in own.items()}
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)

    def below(node):
        leaves, saved = 0 if kids[node] else 1, (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        for k in kids[node]:
            a, b = below(k)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    out = []
    for node, m in members.items():
        ends = ",".join(str(c) for c in m if len(built[c]) == len(node))
        out.append((m[0], len(node), members[node[:-1]][0] if node else None, len(m), len(kids[node]), *below(node), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("bits", [64, 3])
def test_prefix_trie_is_brute_force(spark, small_batches, bits):
    rng = random.Random(9)
    turns = []
    for c in range(60):
        if c in (10, 11):
            continue
        n = 40 if c == 2 else rng.randrange(1, 8)
        for t in range(n):
            turns.append((c, t if t or c % 2 else None, rng.choice(["user", "bot", None]), "hi" if t == 0 else rng.choice(["é", "", None, "yes", "no"])))
    turns += [(None, 0, "user", "x")]
    df = spark.createDataFrame([(*t, 1, "z") for t in turns], "conv_id long, turn long, role string, text string, depth int, print string").repartition(4)
    c, head = F.col("conv_id"), lambda i: zlib.crc32(str(i).encode()) % 9
    rows, members = prefix_trie.rebuilt(prefix_trie.turn_digests(df), c - c % 5, F.pmod(F.crc32(c.cast("string")), F.lit(9)), 8)
    got = prefix_trie.prefix_trie(rows, members, bits).select(TRIE).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_trie(turns, lambda i: i - i % 5, head)


def test_prefix_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    turns = prefix_trie.turn_digests(none)
    assert prefix_trie.prefix_trie(turns, turns).count() == 0
