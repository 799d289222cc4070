"""Similarity join of texts by the Jaccard index of their word shingles, by chosen paths.

Every distinct set gets a MinHash signature; its places are the tokens that paths sample.
A node of the tree is a path of sampled (place, value) tokens: a set goes on to the children
that the node samples, 1/threshold of them on average, so that a pair at the threshold keeps
one shared child on average. Small buckets, buckets whose sets are alike already and buckets
at the last level are compared exactly, by intersections of the full shingle sets; others are
split again. Independent runs repeat this until the expected recall reaches the target.
Before the full sets are fetched, a set leaves each bucket of at most ``block`` sets in which no
other set's signature agrees with its own in as many places as a pair at the threshold does but
for a hundredth of the loss that the recall allows.

Rules for odd input: null text counts as empty; a text without words is similar to nothing
but texts with the same words (none), which count as copies; a text of 1 to 4 words has one
shingle of all of them; equal texts count as copies and are compared once; rows without
doc_id are returned with null class and no links; repeated ids are separate rows; texts of any length are
compared whole; an empty table gives no rows; columns other than doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, components, doc_slices, exact_id, grouped_stream, id_again, lean, mix64, shingles_of, table, text_chunks, words_of, written

PLACES = 64
_A = (mix64(np.arange(101, 101 + PLACES, dtype=U64)) >> U64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix64(np.arange(301, 301 + PLACES, dtype=U64)) >> U64(32)).astype(np.uint32)


def runs_for(recall: float, threshold: float, depth: int) -> int:
    """Runs after which a pair at the threshold is missed with probability 1-recall at most,
    when it must survive ``depth`` levels. All runs sample the same PLACES of a set, so that the
    probability is a mean over the number of places in which the pair agrees."""
    k = 1 / threshold
    more = k - math.floor(k)
    lost, weight = [], []
    for agree in range(PLACES + 1):
        x, p = agree / PLACES, 1.0
        for _ in range(depth):
            p = (1 - more) * (1 - (1 - x * p) ** math.floor(k)) + more * (1 - (1 - x * p) ** (math.floor(k) + 1))
        lost.append(1 - p)
        weight.append(math.comb(PLACES, agree) * threshold**agree * (1 - threshold) ** (PLACES - agree))
    runs = 1
    while sum(w * q**runs for w, q in zip(weight, lost, strict=True)) > 1 - recall:
        runs += 1
    return runs


def least_agreeing(threshold: float, lost: float) -> int:
    """The number of places that signatures of a pair at the threshold share but for a probability of ``lost``."""
    below, cut = 0.0, 0
    while (below := below + math.comb(PLACES, cut) * threshold**cut * (1 - threshold) ** (PLACES - cut)) <= lost:
        cut += 1
    return cut


def _first_places(run: int, threshold: float, seed: int) -> list[int]:
    rng = np.random.default_rng([seed, run])
    k = 1 / threshold
    return rng.choice(PLACES, size=math.floor(k) + int(rng.random() < k - math.floor(k)), replace=False).tolist()


def signature(h: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """MinHash places of each text; ``h`` holds the texts' shingles, cut at ``cuts`` (no empty text)."""
    x = (h >> U64(29)).astype(np.uint32)
    out = np.empty((len(cuts) - 1, PLACES), dtype=np.uint32)
    for i in range(PLACES):
        y = (x ^ _B[i]) * _A[i]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        out[:, i] = np.minimum.reduceat(y, cuts[:-1])
    return out


def _identity(h: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A 64-bit identity of each text's shingles with their counts."""
    return np.add.reduceat(mix64(h ^ U64(0xA0761D6478BD642F)), cuts[:-1]).view(np.int64)


def _sketch(paths: list[list[int]], k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            ids, no_id, texts = pdf["doc_id"].to_numpy(), pdf["no_id"].to_numpy(), pdf["text"].tolist()
            for a, b in text_chunks(ids, texts):
                h, d = shingles_of(words_of(texts[a:b]), k)
                off = doc_slices(d, b - a)
                full = np.flatnonzero(np.diff(off))
                node = np.zeros(b - a, dtype=np.int64)
                size = np.diff(off)
                bits = np.zeros(b - a, dtype=np.int64)
                sig: list = [None] * (b - a)
                keys: list = [None] * (b - a)
                code: list = [None] * (b - a)
                if len(full):
                    cuts = np.append(off[full], off[-1])
                    s = signature(h, cuts)
                    node[full] = _identity(h, cuts)
                    bits[full] = np.packbits((s & np.uint32(1)).astype(bool), axis=1).view(np.int64).ravel()
                    low = s.astype(np.uint8)
                    key = np.empty((len(full), sum(map(len, paths))), dtype=U64)
                    at = 0
                    for r, places in enumerate(paths):
                        for p in places:
                            key[:, at] = mix64(s[:, p].astype(U64) + (U64(r * PLACES + p) << U64(32)))
                            at += 1
                    key = key.view(np.int64)
                    for j, t in enumerate(full):
                        sig[t], keys[t], code[t] = s[j].view(np.int32), key[j], low[j].tobytes()
                yield pd.DataFrame({"doc_id": ids[a:b], "no_id": no_id[a:b], "node": node, "size": size, "bits": bits, "code": code, "sig": sig, "paths": keys})

    return run


def _with_partner(cut: int):
    """Rows of sets whose signature agrees with another one of the bucket in ``cut`` places; a code
    holds the low byte of each place. The stream is sorted by bucket."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[pd.DataFrame] = []
        held = 0
        for _, g in grouped_stream(frames, ["bucket"]):
            x = np.frombuffer(b"".join(g["code"]), dtype=np.uint8).reshape(len(g), PLACES)
            some = np.zeros(len(x), dtype=bool)
            for a in range(0, len(x), 64):
                left = np.flatnonzero(~some)
                if not len(left):
                    break
                alike = np.count_nonzero(x[left, None, :] == x[None, a : a + 64, :], axis=2) >= cut
                itself = left[(left >= a) & (left < a + 64)]
                alike[np.searchsorted(left, itself), itself - a] = False
                some[left[alike.any(axis=1)]] = True
            if some.any():
                out.append(g.loc[some, ["node", "bucket"]])
                held += int(some.sum())
            if held > 20_000:
                yield pd.concat(out)
                out, held = [], 0
        if out:
            yield pd.concat(out)

    return run


def _pairs(threshold: float, k: int):
    """Links within the buckets of a stream sorted by bucket and block."""

    def sets_of(texts: list) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for a, b in text_chunks(texts, texts):
            h, d = shingles_of(words_of(texts[a:b]), k)
            off = doc_slices(d, b - a)
            out += [np.unique(h[off[i] : off[i + 1]]) for i in range(b - a)]
        return out

    def shared(left: list, right: list) -> np.ndarray:
        """Sizes of the intersections of all left with all right sets."""
        n, m = len(left), len(right)
        v = np.concatenate([*left, *right])
        o = np.repeat(np.arange(n + m), [len(x) for x in (*left, *right)])
        order = np.argsort(v, kind="stable")
        v, o = v[order], o[order]
        new = np.append(True, v[1:] != v[:-1])
        first = np.flatnonzero(new)
        both = np.minimum.reduceat(o, first) < n if len(v) else np.zeros(0, bool)
        both &= np.maximum.reduceat(o, first) >= n if len(v) else both
        gid = np.cumsum(new) - 1
        keep = both[gid]
        o, gid = o[keep], (np.cumsum(both) - 1)[gid[keep]]
        out = np.zeros((n, m), dtype=np.float32)
        width = max(64, min(8192, (16 << 20) // max(1, n + m)))
        for c in range(0, int(both.sum()), width):
            lo, hi = np.searchsorted(gid, [c, c + width])
            s = np.zeros((n + m, width), dtype=np.float32)
            s[o[lo:hi], gid[lo:hi] - c] = 1
            out += s[:n] @ s[n:].T
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (bucket, bi, bj), g in grouped_stream(frames, ["bucket", "bi", "bj"]):
            g = g.drop_duplicates("node")
            node, copies, weight, block, other = (g[c].to_numpy() for c in ("node", "size", "copies", "block", "buckets"))
            if len(node) < 2:
                continue
            sets = [np.frombuffer(x, dtype=U64) for x in g["shingles"]]
            n = np.array([len(s) for s in sets], dtype=np.float64)
            del copies
            left = np.arange(len(node)) if bi == bj else np.flatnonzero(block == bi)
            right = left if bi == bj else np.flatnonzero(block == bj)
            if not len(left) or not len(right):
                continue
            i = shared([sets[x] for x in left], [sets[x] for x in right])
            link = i >= threshold * (n[left][:, None] + n[right][None, :] - i) - 1e-6
            if bi == bj:
                np.fill_diagonal(link, False)
            # each pair counts in the least bucket that holds both
            earlier = [np.asarray(x)[np.asarray(x) < bucket] for x in other]
            if any(len(earlier[x]) for x in left) and any(len(earlier[x]) for x in right):
                e, f = [earlier[x].astype(np.int64).view(U64) for x in left], [earlier[x].astype(np.int64).view(U64) for x in right]
                fresh = link & (shared(e, f) == 0)
            else:
                fresh = link
            lw = fresh @ weight[right].astype(np.float64)
            # within the bucket: one edge for each set to the least set that it reaches
            label = np.arange(len(node))
            pairs = link.any(axis=1)
            if not pairs.any():
                continue
            while True:
                low = label.copy()
                for a in range(0, len(left), 1024):
                    rows = link[a : a + 1024]
                    m = np.where(rows, label[right][None, :], len(node)).min(axis=1)
                    low[left[a : a + 1024]] = np.minimum(low[left[a : a + 1024]], m)
                if bi != bj:
                    for a in range(0, len(right), 1024):
                        rows = link[:, a : a + 1024]
                        m = np.where(rows, label[left][:, None], len(node)).min(axis=0)
                        low[right[a : a + 1024]] = np.minimum(low[right[a : a + 1024]], m)
                low = low[low]
                if (low == label).all():
                    break
                label = low
            total = np.zeros(len(node))
            total[left] += lw
            if bi != bj:
                total[right] += weight[left].astype(np.float64) @ fresh
            some = (total > 0) | (label != np.arange(len(node)))
            yield pd.DataFrame({"node": node[some], "links": total[some].astype(np.int64), "to_node": node[label[some]]})

    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for a, b in text_chunks(pdf.index, pdf["text"].tolist()):
                part = pdf.iloc[a:b]
                texts = part["text"].tolist()
                h, d = shingles_of(words_of(texts), k)
                off = doc_slices(d, b - a)
                full = np.flatnonzero(np.diff(off))
                if not len(full):
                    continue
                ident = _identity(h, np.append(off[full], off[-1]))
                part = part.iloc[full]
                same = ident == part["node"].to_numpy()
                sets = [np.unique(h[off[t] : off[t + 1]]).tobytes() for t, s in zip(full, same, strict=True) if s]
                yield part[same].drop(columns=["text"]).assign(shingles=sets)

    return run, fetch


def similar_texts(
    docs: DataFrame,
    threshold: float = 0.8,
    k: int = 5,
    recall: float = 0.9999,
    bucket_limit: int = 256,
    depth: int = 5,
    dense: float = 0.6,
    block: int = 2048,
    seed: int = 7,
) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id reachable by links, its own if it
    has none), n_links (other documents whose shingle sets are at least ``threshold`` similar,
    copies counted each) and kept (doc_id = class_id).

    bucket_limit: sets that a bucket may hold to be compared without a further split.
    dense: a bucket whose sets are as similar as this on average is compared at once, in
    blocks of ``block`` sets, since no split would part them."""
    runs = runs_for(recall, threshold, depth)  # the first buckets and all their splits
    paths = [_first_places(r, threshold, seed) for r in range(runs)]
    rows = docs.select("doc_id", "text")
    sketched = docs.select(*exact_id(), "text").mapInPandas(lean(_sketch(paths, k)), "doc_id long, no_id boolean, node long, size long, bits long, code binary, sig array<int>, paths array<long>")
    sketched = written(sketched.select(id_again(), "node", "size", "bits", "code", "sig", "paths"), "signatures")
    nodes = sketched.where("doc_id is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"))
    # rows of a node are alike in all but doc_id
    reps = sketched.where("size > 0 and doc_id is not null").groupBy("node")
    first = reps.agg(F.first("bits").alias("bits"), F.first("paths").alias("paths")).select("node", "bits", F.explode("paths").alias("bucket"))

    def counted(r: DataFrame, merge: bool = False) -> DataFrame:
        """Rows of buckets with more than one set, with the bucket's count. merge: of buckets
        with the same sets only the least is kept; those still to be split stay apart, since
        each run has its own chance to keep a pair together."""
        if not merge:
            return r.join(r.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket")
        c = r.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor("node").alias("x"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s")).where("n > 1")
        return r.join(c.groupBy("n", "x", "s").agg(F.min("bucket").alias("bucket")).select("bucket", "n"), "bucket")

    open_ = written(counted(first), "buckets")
    leaves = [open_.where(F.col("n") <= bucket_limit).select("node", "bucket")]
    open_ = open_.where(F.col("n") > bucket_limit)
    for level in range(1, depth + 1):
        if open_.isEmpty():
            break
        if level == depth:
            leaves.append(open_.select("node", "bucket"))
            break
        means = open_.groupBy("bucket").agg(*[F.avg(F.bit_get("bits", F.lit(i))).alias(f"p{i}") for i in range(PLACES)])
        like = means.select("bucket", (sum((F.col(f"p{i}") * F.col(f"p{i}") + (1 - F.col(f"p{i}")) * (1 - F.col(f"p{i}"))) for i in range(PLACES)) / PLACES * 2 - 1).alias("like"))
        marked = written(open_.select("node", "bits", "bucket").join(like, "bucket"), "level")
        leaves.append(marked.where(F.col("like") >= dense).select("node", "bucket"))
        more = 1 / threshold - math.floor(1 / threshold)
        take = lambda j: F.pmod(F.xxhash64("bucket", F.lit(j)), F.lit(PLACES)).cast("int")
        child = lambda j: F.xxhash64("bucket", take(j), F.element_at("sig", take(j) + 1))
        n = math.floor(1 / threshold)
        kids = F.concat(
            F.array(*[child(j) for j in range(n)]),
            F.when(F.pmod(F.xxhash64("bucket", F.lit(-1)), F.lit(1 << 20)) < more * (1 << 20), F.array(child(n))).otherwise(F.array().cast("array<long>")),
        )
        apart_ = marked.where(F.col("like") < dense).join(reps.agg(F.first("sig").alias("sig")), "node")
        # counting reads the children twice
        split = written(apart_.select("node", "bits", F.explode(F.array_distinct(kids)).alias("bucket")), "split")
        split = written(counted(split), "buckets")
        leaves.append(split.where(F.col("n") <= bucket_limit).select("node", "bucket"))
        open_ = split.where(F.col("n") > bucket_limit)
    leaf = leaves[0]
    for x in leaves[1:]:
        leaf = leaf.union(x)
    leaf = written(counted(leaf.distinct(), merge=True), "leaves")
    coded = leaf.where(F.col("n") <= block).select("node", "bucket").join(reps.agg(F.first("code").alias("code")), "node")
    cut = least_agreeing(threshold, (1 - recall) / 100)
    held = coded.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(lean(_with_partner(cut)), "node long, bucket long")
    leaf = counted(written(held.union(leaf.where(F.col("n") > block).select("node", "bucket")), "partners"), merge=True)

    n_blocks = F.ceil(F.col("n") / block).cast("int")
    placed = leaf.withColumn("nb", n_blocks).withColumn("block", F.pmod(F.xxhash64("node", "bucket"), F.col("nb")).cast("int"))
    wanted = placed.groupBy("node").agg(F.array_sort(F.collect_list("bucket")).alias("buckets"), F.collect_list(F.struct("bucket", "nb", "block")).alias("at"))
    wanted = wanted.join(nodes, "node").select("node", F.col("rep").alias("doc_id"), "copies", "buckets", "at")
    run, fetch = _pairs(threshold, k)
    sets = (
        rows.join(wanted, "doc_id")
        .select("text", "node", "copies", "buckets", "at")
        .mapInPandas(
            lean(fetch),
            "node long, copies long, buckets array<long>, at array<struct<bucket:long,nb:int,block:int>>, shingles binary",
        )
    )
    spread = (
        sets.select("node", "copies", "buckets", "shingles", F.explode("at").alias("at"))
        .select("node", "copies", "buckets", "shingles", "at.*")
        .select(
            "node", "copies", F.lit(0).alias("size"), "buckets", "shingles", "bucket", "block",
            F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o"),
        )
        .withColumn("bi", F.least("block", "o"))
        .withColumn("bj", F.greatest("block", "o"))
        .drop("o")
    )
    found = written(
        spread.repartition("bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj").mapInPandas(lean(run), "node long, links long, to_node long"),
        "links",
    )
    comp = components(found, "node", "to_node")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    by_node = nodes.join(links, "node", "left").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = by_node.groupBy("component").agg(F.min("rep").alias("class_id"))
    by_node = by_node.join(least, "component").select("node", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    known = sketched.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
    return known.join(by_node, "node", "left").select(
        "doc_id", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept")
    )


def op4_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar_texts(table(spark, sf_dir, "documents"))
