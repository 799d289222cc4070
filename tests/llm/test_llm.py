"""The training-data operators against brute force on small fixtures, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chaining, common, elias_fano, fingerprints, links, mixing, near_vectors, ngram_join, ngram_lm, packing, pii, seeds, suffix_array, toxicity

WORDS = [f"w{i}x" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = [prose(rng, rng.randint(20, 200)) for _ in range(40)]
    passage = prose(rng, 70)
    out[3] = out[3] + " " + passage + " " + prose(rng, 10)
    out[9] = prose(rng, 30) + "\n" + passage.upper() + "! " + prose(rng, 5)
    near = out[5].split()
    near[len(near) // 2] = "changed"
    out += [out[5], " ".join(near), " ".join([*near, "more"]), None, "", "one", "one two three", "one two three", prose(rng, 9000), "  \n ", "äöü ß ".strip() * 7]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), "clash", i) for i, t in enumerate(texts)]
    rows += [rows[2], (None, texts[2], "en", "s1", 5, "clash", -1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string, component long")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def shingle_set(t, k=5):
    w = re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (t or "").lower())
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def test_word_hash_and_shingles():
    w = common.words_of(["a b, A", None, "b"])
    assert w.off.tolist() == [0, 3, 3, 4] and w.hash[0] == w.hash[2] and w.hash[1] == w.hash[3] != w.hash[0]
    h, d = common.shingles_of(common.words_of(["a b c d e f", "a b c d e", "a b", "", "a b"]))
    assert d.tolist() == [0, 0, 1, 2, 4] and h[0] == h[2] and h[3] == h[4] and h[3] not in h[:3]
    long = "x" * (9 << 20)  # one word longer than a chunk
    assert common.words_of([long + " y", "y"]).hash[1] == common.words_of(["y"]).hash[0]


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (5, 4), (4, 4), (None, 1)] + [(100, i) for i in range(101, 140)], "a long, b long")
    got = {r["node"]: r["component"] for r in common.components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 5: 4, 4: 4} | {i: 100 for i in range(100, 140)}
    assert common.components(e.limit(0)).count() == 0


def test_op1_mixing_meets_targets(spark, docs, none):
    assert mixing.mix(none).count() == 0
    tokens = [1000, 100, 10]
    a = mixing.exponent_for(tokens, 0.9, 1e9, 1110)
    assert abs(mixing.entropy(mixing.weights_at(tokens, a)) - 0.9 * math.log(3)) < 1e-6
    b = mixing.exponent_for(tokens, 0.9, 3.0, 1110)
    assert b > a and abs(max(mixing.passes(tokens, mixing.weights_at(tokens, b), 1110)) - 3) < 1e-6
    got = mixing.mix(docs, budget=None, entropy_share=1.0, most_passes=100.0, block_docs=4)
    assert got.columns[: len(docs.columns)] == docs.columns
    n = {r["source"]: r["n"] for r in got.groupBy("source").agg(F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S+")) + 1).alias("n")).collect()}
    most = max(len((t or "").split()) + 1 for t in [x["text"] for x in docs.collect()])
    assert max(n.values()) - min(n.values()) <= 2 * most  # equal weights up to the last document
    kept = {r["doc_id"] for r in got.collect()}
    assert kept == {r["doc_id"] for r in docs.collect()}
    again = mixing.mix(docs, budget=None, entropy_share=1.0, most_passes=100.0, block_docs=4)
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))


def test_op2_toxicity(spark, none):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        bad = i % 10 == 0
        t = prose(rng, 40) + (" zorkish zorkan" if bad else "")
        rows.append((i, t, "x"))
        if i % 2 == 0:
            labels.append((i, 1, 1 if bad else 0))
    rows += [(None, None, "x"), (700, "", "x"), (0, rows[0][1], "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, score string")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5000, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    w, b, prior = toxicity.train(d, lab)
    got = toxicity.score(d, w, b).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 600]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] for r in got if r["doc_id"] is not None)
    assert sum((r["doc_id"] % 10 == 0) == bool(r["predicted"]) for r in held) >= 0.97 * len(held)
    clean = toxicity.without_toxic(d, w, b)
    assert clean.columns == d.columns and clean.where("doc_id < 600 and doc_id % 10 != 0").count() >= 530
    # nothing to learn from
    assert toxicity.train(d, lab.limit(0))[0] == {} and toxicity.score(d.limit(0), {}, -3.0).count() == 0


def test_op3_links_and_components(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(120, 16))
    dense = rng.normal(size=16) + rng.normal(size=(90, 16)) * 0.05  # more links than a beam holds
    v = np.concatenate([base, base[:20] + rng.normal(size=(20, 16)) * 0.05, base[:5], dense]).astype(np.float32)
    rows = [(i, [float(x) for x in row], int(i % 2) if i < 120 else int((i - 120) % 2) if i < 140 else 0) for i, row in enumerate(v)]
    odd = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] + [1.0] * 15, 1), (1003, None, None), (1004, [1.0] * 15 + [None], 1), (1005, [], 1), (None, rows[0][1], 0), (1006, rows[0][1], None)]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in near_vectors.near_vectors(df, shard=64).collect()}
    assert len(got) == len(rows) + len(odd)
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows])
    link = (u @ u.T >= 0.98) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(link, False)
    label = np.arange(len(rows))
    while True:
        low = np.minimum(label, np.where(link, label[None, :], len(rows)).min(axis=1))
        if (low == label).all():
            break
        label = low
    assert [got[i]["n_links"] for i in range(len(rows))] == link.sum(axis=1).tolist()
    assert [got[i]["component_id"] for i in range(len(rows))] == label.tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in (1000, 1001, 1002, 1003, 1004, 1005, 1006))
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


def test_op4_links_and_classes(spark, docs, texts, none):
    ids = [(i * 3, t) for i, t in enumerate(texts)] + [(6, texts[2])]
    sets = [shingle_set(t) for _, t in ids]
    n = len(ids)
    link = [[i != j and (sets[i] == sets[j] if not sets[i] or not sets[j] else len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) for j in range(n)] for i in range(n)]
    want = {}
    for i, (d, _) in enumerate(ids):
        want[d] = sum(link[i])
    for kw in ({}, {"bucket_limit": 1, "dense": 2.0}, {"bucket_limit": 1, "block": 2}):
        got = ngram_join.similar_texts(docs, **kw).collect()
        assert len(got) == n + 1
        assert {r["doc_id"]: r["n_links"] for r in got if r["doc_id"] is not None} == want
        by = {r["doc_id"]: r["class_id"] for r in got}
        assert by[5 * 3] == by[40 * 3] == by[41 * 3] == by[42 * 3] == 15 and by[None] is None
    assert ngram_join.similar_texts(none).count() == 0
    assert 1 - (1 - 0.84) ** ngram_join.runs_for(0.999, 0.8, 1) >= 0.999


def test_op4_runs_reach_the_recall_at_the_last_level(none, monkeypatch):
    runs = ngram_join.runs_for(0.9999, 0.8, 5)
    rng = np.random.default_rng(4)
    agree = rng.binomial(ngram_join.PLACES, 0.8, 200_000) / ngram_join.PLACES
    missed = np.ones(len(agree), dtype=bool)
    for _ in range(runs):
        nodes = np.ones(len(agree), dtype=np.int64)
        for _ in range(5):
            nodes = rng.binomial(nodes + rng.binomial(nodes, 0.25), agree)
        missed &= nodes == 0
    assert missed.mean() < 2e-4
    asked = []
    monkeypatch.setattr(ngram_join, "runs_for", lambda *a: asked.append(a) or 1)
    ngram_join.similar_texts(none, depth=5)
    assert asked == [(0.9999, 0.8, 5)]


def test_op4_sets_without_a_partner_leave_their_bucket():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 256, (300, ngram_join.PLACES)).astype(np.uint8)
    x[150:200, :50] = x[7, :50]
    x[299, :40], x[1, 24:] = x[100, :40], x[2, 24:]
    pdf = pd.DataFrame({"bucket": [1] * 200 + [2] * 98 + [3] * 2, "node": range(300), "code": [r.tobytes() for r in x]})
    for cut in (30, 40, 41):
        same = (x[:, None] == x[None]).sum(axis=2) >= cut
        same &= (pdf["bucket"].to_numpy()[:, None] == pdf["bucket"].to_numpy()[None]) & ~np.eye(300, dtype=bool)
        for parts in ([pdf], [pdf[:10], pdf[10:199], pdf[199:]]):
            got = pd.concat(ngram_join._with_partner(cut)(iter(parts)))
            assert sorted(got["node"]) == np.flatnonzero(same.any(axis=1)).tolist()


def test_op4_partners_at_the_threshold_stay():
    cut = ngram_join.least_agreeing(0.8, 1e-6)
    below = lambda c: sum(math.comb(64, i) * 0.8**i * 0.2 ** (64 - i) for i in range(c))
    assert below(cut) <= 1e-6 < below(cut + 1)


def test_op5_fingerprints(spark, docs, texts, none, tmp_path):
    s = fingerprints.sketches(["a b c d e f g h", "a b c d e f g h", "", None, "a"])
    assert str(s[0]) == str(s[1]) and str(s[2]) == str(s[3]) and fingerprints.likeness(s[2], s[3]) == 1 and fingerprints.likeness(s[2], s[4]) == 0
    assert str(fingerprints.read_sketch(str(s[0]))) == str(s[0])
    rng = random.Random(1)
    a, b = prose(rng, 4000), prose(rng, 4000)
    x, y, xy = fingerprints.sketches([a, b, a + " " + b])
    assert fingerprints.containment(x, xy) > 0.95 and 0.4 < fingerprints.likeness(x, xy) < 0.6
    assert len(np.setdiff1d(fingerprints.merged(x, y).kept, xy.kept)) == 0
    docs.where("doc_id is not null").dropDuplicates(["doc_id"]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in fingerprints.op5_fingerprints(spark, str(tmp_path)).collect()}
    t = [x or "" for x in texts]
    assert len(got) == len(t)
    for i, x in enumerate(t):
        nxt = t[(i + 1) % len(t)]
        edited = x[: len(x) - len(x) // 4] + nxt[: len(x) // 4]
        r = got[i * 3]
        assert r["n_chars"] == len(x) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        p, q, z = fingerprints.sketches([x, edited, nxt])
        assert (r["fingerprint"], r["edited_fingerprint"]) == (str(p), str(q)) and (r["near_edited"], r["near_next"]) == (fingerprints.likeness(p, q), fingerprints.likeness(p, z))
    assert fingerprints.fingerprints(none).count() == 0


def test_op6_packing(spark, docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.pack(docs).collect()
    rows = docs.collect()
    want = Counter((r["doc_id"], tuple([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1])) for r in rows)
    assert sum(x["length"] for x in got) == sum(len(ids) * n for (_, ids), n in want.items())
    crc = Counter()
    for (doc, ids), n in want.items():
        for s in range(0, len(ids), 2048):
            part = np.array(ids[s : s + 2048], dtype="<u4")
            crc[(doc, s, len(part), zlib.crc32(part.tobytes()), len(ids))] += n
    assert Counter((x["doc_id"], x["start"], x["length"], x["ids_crc32"], x["doc_tokens"]) for x in got) == crc
    by: dict = {}
    for x in got:
        by.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for pieces in by.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack(none).count() == 0
    odd = ["don't <|endoftext|> 1½ \x1c a　b  c\n\n d", "it's  ok\nnow _x", " lead", "trail ", "a\tb c", "é́ ²", "x\ny z\nw"]
    enc = packing.encoder(packing.default_tokenizer())
    assert all(enc(t) == enc.direct(t) for t in odd)


def test_op6_patterns_hold_all_pieces_with_little_padding():
    rng = np.random.default_rng(4)
    for n in (0, 1, 3, 500, 5000):
        counts = np.bincount(rng.integers(1, 257, n), minlength=257)
        pats = packing.patterns_for(counts, 256)
        held = np.zeros(257, dtype=int)
        for pat, times in pats:
            assert sum(c * k for c, k in pat.items()) <= 256 and times > 0
            for c, k in pat.items():
                held[c] += k * times
        assert (held == counts).all()
    bins = sum(t for _, t in pats)
    assert (counts * np.arange(257)).sum() / (256 * bins) > 0.98
    best, pat = packing.price(np.array([0, 0.1, 0.3, 0, 0.55, 0]), 5)
    assert math.isclose(best, 0.7) and (pat * np.arange(6)).sum() <= 5  # 2 + 2 + 1 against 4 + 1


def passages(texts, ids, least):
    sets = {}
    for d, t in zip(ids, texts, strict=True):
        w = re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (t or "").lower())
        for i in range(len(w) - least + 1):
            sets.setdefault(tuple(w[i : i + least]), set()).add(d)
    return sets


def test_op7_repeats(spark, docs, texts, none):
    got = suffix_array.repeats(docs).collect()
    shared = passages(texts, range(0, 3 * len(texts), 3), 50)
    docs_with = {d for s in shared.values() if len(s) > 1 for d in s}
    assert {r["doc_id"] for r in got} == docs_with and {9, 27, 15, 120} <= docs_with
    span = next(r for r in got if r["doc_id"] == 27)
    assert (span["start"], span["n_words"], span["other_doc"]) == (30, 70, 9)
    assert suffix_array.repeats(none).count() == 0


def test_op7_a_repeat_around_a_frequent_line(spark):
    rng = random.Random(21)
    words = [f"v{i}" for i in range(20000)]
    fresh = lambda n: [rng.choice(words) for _ in range(n)]
    line, left, right = fresh(45), fresh(10), fresh(10)
    texts = [[*fresh(80), *line, *fresh(80)] for _ in range(300)]
    for i in range(0, 60, 2):  # pairs share ten words before the line, or ten after it
        left, right = fresh(10), fresh(10)
        for t in texts[i : i + 2]:
            t[70:80] = left if i % 4 else t[70:80]
            t[125:135] = t[125:135] if i % 4 else right
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r["doc_id"], r["start"], r["end"], r["other_doc"]) for r in suffix_array.repeats(d).collect()}
    assert got == {(i, 70 if i // 2 % 2 else 80, 125 if i // 2 % 2 else 135, i ^ 1) for i in range(60)}


def test_op7_spans_equal_brute_force(spark):
    rng = random.Random(22)
    pool = [[f"v{rng.randint(0, 3000)}" for _ in range(rng.randint(20, 120))] for _ in range(12)]
    texts = []
    for _ in range(80):
        t = []
        for p in rng.sample(pool, 3):
            a = rng.randint(0, len(p) // 3)
            t += p[a:] + [f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 3))]
        texts.append(t)
    owners = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - 49):
            owners.setdefault(tuple(t[i : i + 50]), set()).add(d)
    want = set()
    for d, t in enumerate(texts):
        spans = []
        for i in range(len(t) - 49):
            others = owners[tuple(t[i : i + 50])] - {d}
            if others:
                if spans and i <= spans[-1][1]:
                    spans[-1] = [spans[-1][0], i + 50, min(spans[-1][2], *others)]
                else:
                    spans.append([i, i + 50, min(others)])
        want |= {(d, *s) for s in spans}
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert len(want) > 40 and {(r["doc_id"], r["start"], r["end"], r["other_doc"]) for r in suffix_array.repeats(rows).collect()} == want


def test_op8_scores(spark, docs, texts, none):
    ids = [(r["doc_id"], r["text"]) for r in docs.collect()]
    low = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x or "")
    toks = [[*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None] for _, t in ids]
    train = [w for (d, _), w in zip(ids, toks, strict=True) if d is None or zlib.crc32(str(d).encode()) % 10]
    c = Counter(x for w in train for x in w)
    n, v = sum(c.values()), len(c)
    b = Counter(p for w in train for p in zip(["<"] + w, w, strict=False))
    g = Counter(p for w in train for p in zip(["<", "<"] + w, ["<"] + w, w, strict=False))
    want = []
    for (d, _), w in zip(ids, toks, strict=True):
        x, s, base = ["<", *w], 0.0, 0.0
        for j in range(1, len(x)):
            p1 = (c[x[j]] + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(p1)
            p2 = (b[x[j - 1], x[j]] + 7 * p1) / ((c[None] if j == 1 else c[x[j - 1]]) + 7)
            s += math.log10(p2 if j == 1 else (g[x[j - 2], x[j - 1], x[j]] + 3 * p2) / (b[x[j - 2], x[j - 1]] + 3))
        want.append((d, len(w), sum(c[t] > 0 for t in w), n, round(base, 6), round(s, 6)))
    got = [(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in ngram_lm.score_all(docs, m2=7.0, m3=3.0).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert ngram_lm.score_all(none).count() == 0


def test_op8_different_ngrams_stay_apart_in_one_shard():
    rng = np.random.default_rng(8)
    n = 200_000
    hashes = np.unique(rng.integers(1, 1 << 63, n, dtype=np.uint64))
    n = len(hashes)
    one = np.full(n, 77, dtype=np.uint64)
    for left, right in ((hashes, one), (one, hashes)):  # many contexts of a word, many words of a context
        t = ngram_lm.Tokens(np.stack([left, right], 1).ravel(), np.arange(0, 2 * n + 1, 2))
        for order in (2, 3):
            _, keys, at = t.distinct(order, 1)
            assert len(np.unique(at[1::2])) == n


def test_op8_great_counts_are_exact(spark):
    rows = [(i, "x y z") for i in range(1500)] + [(9000, "x y"), (9001, "y z")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    train = [t.split() + [None] for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    c, b, g = Counter(), Counter(), Counter()
    for w in train:
        x = ["<", "<", *w]
        c.update(w)
        b.update(zip(x[1:], x[2:], strict=False))
        g.update(zip(x, x[1:], x[2:], strict=False))
    n, v, m2, m3 = sum(c.values()), len(c), 7.0, 3.0
    x, want = ["<", "x", "y", "z", None], 0.0
    for j in range(1, 5):
        p1 = (c[x[j]] + 0.1) / (n + 0.1 * (v + 1))
        p2 = (b[x[j - 1], x[j]] + m2 * p1) / ((c[None] if j == 1 else c[x[j - 1]]) + m2)
        want += math.log10(p2 if j == 1 else (g[x[j - 2], x[j - 1], x[j]] + m3 * p2) / (b[x[j - 2], x[j - 1]] + m3))
    got = ngram_lm.score_all(d, m2=m2, m3=m3).where("doc_id = 0").first()["score"]
    assert got == pytest.approx(want, abs=1e-9)


def test_op8_elias_fano_and_trie():
    rng = np.random.default_rng(6)
    for n, bits in ((0, 44), (1, 44), (900, 44), (5000, 63), (50, 64)):
        x = np.unique(rng.integers(0, (1 << bits) - 1, n, dtype=np.uint64))
        blob = elias_fano.encode(x, bits)
        assert (elias_fano.decode(blob) == x).all()
        q = np.concatenate([x, rng.integers(0, (1 << bits) - 1, 100, dtype=np.uint64)])
        assert (elias_fano.Sequence(np.frombuffer(blob, np.uint8)).search(q) == np.searchsorted(x, q)).all()
    counts = np.array([0, 1, 190, 191, 192, 400, 10**6])
    code = ngram_lm.quantise(counts)
    assert (ngram_lm.restored(code) <= counts).all() and (ngram_lm.restored(code, up=True) >= counts).all() and (ngram_lm.restored(code)[:4] == counts[:4]).all()


def test_op9_spans_equal_the_patterns(docs, none):
    def brute(t):
        out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub(r"\D", "", m.group())
            if 14 <= len(d) <= 19 and pii._luhn(d):
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
        return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))

    rng = random.Random(1)
    cases = ["".join(rng.choice("0123456789.+-@ ab(%_é") for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    cases += ["4539578763621486", "mail a@b.co, 10.0.0.1 +1 (555) 123-4567", "", "1.2.3.4.5.6.7.8", "300.1.1.1 00000000255.1.1.1"]
    assert all([s for s in pii.find(t) if s[0] in pii.BASE] == brute(t) for t in cases)
    t = "Contact a@b.co or account: DE44 5001 0517 5407 now https://u:p@h.io/x"
    kinds = {k for k, _, _ in pii.find(t)}
    assert {"email", "account", "url"} <= kinds and pii.redacted(t, pii.find(t)).startswith("Contact [EMAIL] or account: [ACCOUNT] now [URL]")
    clean = pii.without_pii(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count() and pii.without_pii(none).count() == 0
    assert pii.find(None) == []


def test_op10_fuzzy_passages(spark, docs, texts, none):
    got = chaining.fuzzy_passages(docs).collect()
    pairs = {(r["a_doc"], r["b_doc"]) for r in got}
    assert (9, 27) in pairs and any(15 in p for p in pairs)
    r = next(x for x in got if (x["a_doc"], x["b_doc"]) == (9, 27))
    assert r["b_start"] == 30 and r["b_end"] == 100 and r["matches"] == 70
    rng = random.Random(9)
    p = prose(rng, 120).split()
    q = [("new" if i % 25 == 24 else w) for i, w in enumerate(p) if i % 40 != 39]
    d = spark.createDataFrame([(1, prose(rng, 50) + " " + " ".join(p)), (2, " ".join(q) + " " + prose(rng, 60)), (3, prose(rng, 300))], "doc_id long, text string")
    (r,) = chaining.fuzzy_passages(d).collect()
    assert (r["a_doc"], r["b_doc"]) == (1, 2) and r["a_end"] - r["a_start"] > 90 and 0.85 < r["identity"] < 1
    assert chaining.fuzzy_passages(none).count() == 0


def test_op10_every_pair_of_fuzzy_copies_meets(spark):
    rng = random.Random(11)
    words = [f"v{i}" for i in range(20000)]
    fresh = lambda n: [rng.choice(words) for _ in range(n)]
    passage = fresh(60)
    edited = [fresh(15) + [rng.choice(words) if rng.random() < 0.1 else w for w in passage] + fresh(15) for _ in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(edited)] + [(100, " ".join(edited[7])), (101, " ".join(edited[7]))]
    got = {(r["a_doc"], r["b_doc"]) for r in chaining.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(7, 100), (7, 101)} <= got  # equal documents are paired with their least one
    assert sum(a < 40 and b < 40 for a, b in got) >= 0.9 * 40 * 39 / 2


def test_op10_chains_equal_brute_force():
    rng = random.Random(3)
    for _ in range(40):
        a, b = zip(*{(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(12)}, strict=True)
        k, gap = 5, 0.05
        order = sorted(range(len(a)), key=lambda i: (a[i], b[i]))
        best = {}
        for m in order:
            best[m] = float(k)
            for p in order:
                if a[p] < a[m] and b[p] < b[m] and p in best:
                    best[m] = max(best[m], best[p] - gap * (a[m] - a[p] + b[m] - b[p]) + k)
        # the tree maximises the score without the discount for overlaps, which can only lower it
        assert chaining.chains(list(a), list(b), k, gap)[0][0] <= max(best.values()) + 1e-9
        far = [(7 * x, 7 * y) for x, y in zip(a, b, strict=True)]
        assert chaining.chains([x for x, _ in far], [y for _, y in far], k, gap / 7)[0][0] == pytest.approx(max(best.values()))


def test_great_ids_beside_a_null_stay_exact(spark):
    a, b = (1 << 60) + 1, (1 << 60) + 3
    d = spark.createDataFrame([(a, "one two three four five six"), (b, "seven eight nine ten eleven twelve"), (None, "one two")], "doc_id long, text string").coalesce(1)
    ids = lambda df: sorted({r["doc_id"] for r in df.select("doc_id").collect()}, key=lambda x: (x is None, x or 0))
    every = [toxicity.score(d, {}, -3.0), ngram_join.similar_texts(d), fingerprints.fingerprints(d), packing.pack(d), ngram_lm.score_all(d), pii.find_all(d), mixing.mix(d.withColumn("source", F.lit("s")))]
    assert all(ids(x) == [a, b, None] for x in every)
    passage = " ".join(f"p{i}" for i in range(60))
    two = spark.createDataFrame([(a, passage), (b, passage + " end"), (None, passage)], "doc_id long, text string").coalesce(1)
    assert ids(suffix_array.repeats(two)) == [a, b]
    assert ids(chaining.spans(chaining.fuzzy_passages(two))) == [a, b]


def test_columns_that_clash_with_results_stay(spark):
    d = spark.createDataFrame([(1, "a b", "s", 1, 2, 3, 4, 5, 6), (2, "c", "s", 1, 2, 3, 4, 5, 6)], "doc_id long, text string, source string, left int, t int, whole int, bound int, _n int, copy int")
    got = mixing.mix(d, budget=None, entropy_share=1.0, most_passes=1.0)
    assert got.columns == [*d.columns[:-1], "copy_", "copy", "block", "block_order"] and got.count() == 2
    found = pii.find_all(d.withColumn("spans", F.lit("own")))
    assert found.columns[-2:] == ["spans_", "spans"] and found.first()["spans_"] == "own"


def test_op3_repeated_ids_are_vectors_of_their_own(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.001], 0), (3, [0.001, 1.0], 0), (4, [1.0, 0.0], 0)]
    got = near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 1, 1), (1, 2, 1), (2, 2, 1), (3, 1, 1), (4, 2, 1)]


def test_op10_large_groups_lose_no_document(spark):
    rng = random.Random(13)
    words = [f"v{i}" for i in range(20000)]
    passage = [rng.choice(words) for _ in range(80)]
    texts = [[rng.choice(words) for _ in range(20)] + [rng.choice(words) if rng.random() < 0.08 else w for w in passage] for _ in range(150)]
    own = [[rng.choice(words) for _ in range(12)] for _ in range(2)]  # two of them also share words before the passage
    texts[7][8:20] = texts[90][8:20] = own[0]
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = chaining.fuzzy_passages(d).collect()
    assert {r["a_doc"] for r in got} | {r["b_doc"] for r in got} == set(range(150))
    assert (7, 90) in {(r["a_doc"], r["b_doc"]) for r in got}
    assert len(got) < 150 * 149 / 2


def test_op10_links_every_pair_of_a_large_group(spark):
    rng = random.Random(17)
    words = [f"v{i}" for i in range(20000)]
    fresh = lambda n: [rng.choice(words) for _ in range(n)]
    passage = fresh(80)
    texts = [fresh(20) + [rng.choice(words) if rng.random() < 0.05 else w for w in passage] for _ in range(70)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(100, " ".join(texts[3])), (200, " ".join(fresh(90))), (300, "a b"), (301, "a b")]
    got = {r["doc_id"]: r for r in chaining.linked_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {*range(70), 100}
    assert all(r["class_id"] == 0 and r["n_links"] == 70 for r in got.values())
    assert (got[100]["start"], got[100]["end"], got[3]["end"]) == (0, 100, 100)


def test_op10_matches_by_blocks_are_all_pairs(spark):
    rng = random.Random(19)
    rows = [(rng.randint(0, 3), d, 9 * i + rng.randint(0, 8), i) for d in range(50) for i in range(3)]
    again, out = {}, []
    for key, d, place, i in rows:
        again[key, d] = again.get((key, d), -1) + 1
        out.append([key, d, place, i, again[key, d]])
    out = [(*r, again[r[0], r[1]] + 1) for r in out]
    got = seeds.matches(spark.createDataFrame(out, "key long, doc long, place int, i int, again int, times int"), whole=True, block=7)[0].collect()
    want = []
    for x in out:
        for y in out:
            if x[0] == y[0] and x[1] < y[1] and (x[5] == 1 or y[5] == 1 or x[4] == y[4]):
                want.append((x[1], y[1], x[2] << 32 | y[2]))
    assert sorted((r["a"], r["b"], r["at"]) for r in got) == sorted(want)


def test_op10_sends_no_matches_of_a_large_group(spark, monkeypatch):
    rng = random.Random(29)
    words = [f"v{i}" for i in range(20000)]
    fresh = lambda n: [rng.choice(words) for _ in range(n)]
    line, passage = fresh(10), fresh(60)
    texts = [fresh(30) + line + fresh(30) for _ in range(200)] + [fresh(20) + passage + fresh(20) for _ in range(60)] + [fresh(5) + ["ha"] * 40 + fresh(40) for _ in range(20)]
    texts += [passage[:28] + fresh(12) + passage[30:58], fresh(60)]  # a chain of two runs
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    made = {}
    keep = links.written_at
    monkeypatch.setattr(chaining, "written_at", lambda df, name, *a: made.setdefault(name, keep(df, name, *a)))
    got = {r["doc_id"]: r for r in chaining.linked_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {*range(200, 260), 280}
    assert all(r["n_links"] == 60 and r["class_id"] == 200 for r in got.values())
    assert "met" not in made and "chains" not in made and {"pairs", "found"} <= set(made)


def test_op10_small_blocks_give_the_same_links(spark):
    rng = random.Random(31)
    words = [f"v{i}" for i in range(20000)]
    passage = [rng.choice(words) for _ in range(60)]
    texts = [(passage[:20] * (i % 3)) + [rng.choice(words) if rng.random() < 0.05 else w for w in passage] for i in range(30)]
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sizes = spark.createDataFrame([], "doc long, size long")
    whole, parts = ([sorted(map(tuple, links.counted(links.links_of(d, sizes, 5, 4, 50, 0.6, b)[0].where("other is null")).collect())) for b in (2048, 4)])
    assert whole == parts and len(whole) == 30


def test_op4_splits_are_made_once(spark, monkeypatch):
    rng = random.Random(23)
    base = [f"q{i}" for i in range(60)]
    rows = [(i, " ".join(w if rng.random() < 0.9 else f"z{rng.random()}" for w in base)) for i in range(120)]
    made, keep = [], ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, name: (made.append(df._jdf.queryExecution().optimizedPlan().toString().count("explode(array_distinct")), keep(df, name))[1])
    assert ngram_join.similar_texts(spark.createDataFrame(rows, "doc_id long, text string"), bucket_limit=8).count() == 120
    assert 1 <= sum(made) <= 4 and max(made) == 1
