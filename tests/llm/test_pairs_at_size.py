"""What operators on pairs write and send must not grow with the number of pairs."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_lines_negatives_trie import brute_negatives
from tidemark.llm import hard_negatives as hn
from tidemark.llm import links, seeds
from tidemark.llm.common import words_of


@pytest.mark.parametrize("part", [1 << 16, 20])
def test_hard_negatives_leave_a_task_once(spark, monkeypatch, part):
    """Each anchor's first rows leave a task, not each pair of blocks."""
    for name, value in (("BLOCK", 16), ("ANCHORS", 4), ("WORK", 200), ("PART", part)):
        monkeypatch.setattr(hn, name, value, raising=False)
    counts = {}

    def written(df, name, *more, keep=hn.written):
        df = keep(df, name, *more)
        counts[name] = df.count()
        return df

    monkeypatch.setattr(hn, "written", written)
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(3)), [float(x) for x in np.round(rng.normal(size=4) + 1, 1)]) for i in range(400)]
    rows += [(400 + i, i % 2, [0.5, 0.5, 1.0, 0.5]) for i in range(60)]  # copies, whose scores tie
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    got = hn.hard_negatives(hn.integer_rows(df, F.col("embedding"), 256), F.col("vec_id") % 5 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows, 256, 5)
    anchors, tasks = 92, 4
    assert counts["positives"] <= tasks * anchors * 5 and counts["negatives"] <= tasks * anchors * 15


def test_op10_packs_of_seeds_are_brute_force(spark):
    """A bucket of a task is one row, and what is told of a seed is that of all its rows."""
    rng = random.Random(37)
    words = [f"v{i}" for i in range(9)]
    texts = [" ".join(rng.choice(words) if rng.random() < 0.5 else f"v{j % 5}" for j in range(60)) for _ in range(40)]
    d = spark.createDataFrame([(i * 7, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    packs = links.seeds_beside(d, 5, 4, 8, most=100)
    plain = []
    for i, t in enumerate(texts):
        w = words_of([t])
        place, key = seeds.minimisers(w.hash, w.off, 5, 4)
        again, times = seeds.ranks(np.zeros(len(key), dtype=int), key)
        mark = lambda a, b, p, key=key, place=place, times=times: ((int(key[a]) + int(place[b] - place[p]) & (1 << 64) - 1) >> 33) | 1 if times[a] == 1 and place[b] - place[p] <= 5 else 0
        for x in range(len(place)):
            before = mark(x - 1, x, x - 1) if x else 0
            behind = mark(x + 1, x + 1, x) if x + 1 < len(place) else 0
            plain.append((int(key.view(np.int64)[x]), i * 7, int(place[x]), int(again[x]), before, behind, int(times[x])))
    by = defaultdict(list)
    for r in plain:
        by[r[0]].append(r)
    want, block = [], 4
    for rows in by.values():
        if len({r[1] for r in rows}) < 2:
            continue
        ones, twos = sum(r[6] == 1 for r in rows), len({r[1] for r in rows if r[6] > 1})
        inside = all(len({r[c] for r in rows}) == 1 and rows[0][c] for c in (4, 5))
        for r in rows:
            several = -(-twos // block) if r[6] > 1 and twos > 1 else 0
            want.append((*r[:6], r[6] > 1, -(-ones // block), -(-(len(rows) - ones) // block), several, inside))
    got = links.shared_seeds(packs, block).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 100
    assert packs.count() < len(plain) / 2


def test_op10_pairs_of_blocks_are_sent_by_turns(spark, monkeypatch):
    """No job sends more than about as many rows as the seeds have, and the links are those of one job."""
    rng = random.Random(41)
    words = [f"v{i}" for i in range(20000)]
    passage = [rng.choice(words) for _ in range(60)]
    texts = [(passage[:20] * (i % 3)) + [rng.choice(words) if rng.random() < 0.05 else w for w in passage] for i in range(40)]
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sizes = spark.createDataFrame([], "doc long, size long")
    told = lambda got: sorted(map(tuple, links.counted(got.where("other is null")).collect()))
    whole = told(links.links_of(d, sizes, 5, 4, 50, 0.6)[0])
    monkeypatch.setattr(links, "FEW", 1, raising=False)
    jobs = []
    keep = links.written_at
    monkeypatch.setattr(links, "written_at", lambda df, name, *more: jobs.append(name) or keep(df, name, *more))
    assert told(links.links_of(d, sizes, 5, 4, 50, 0.6, 4)[0]) == whole and len(whole) == 40
    assert jobs.count("near") == 2 and jobs.count("links") > 4
