"""Near-duplicate embeddings by hierarchical navigable small-world graphs.

Vectors with equal components and label are one node. The nodes of a label are dealt to shards
of bounded size; each shard gets a graph, built in numpy by batches, layer by layer. Every
shard is queried with all nodes of its label, in blocks: a beam goes down the layers and then
over the lowest one. A beam that holds nothing but links is widened for its query, and beyond
that shared with the queries around it; a sample of each block is compared with all vectors of the shard, and while less than ``recall``
of the sample's links were found, all beams are widened. Candidates are verified by cosine in
double precision; links within a block and shard are reduced to one edge a node before the
components are united.

Rules for odd input: vectors that are null, empty, zero, or hold null or non-finite components,
and vectors without a label, link with nothing and are components of their own; vectors of
different lengths are not compared; rows without vec_id come back without component; rows that share a vec_id are
vectors of their own, which link by their components only; equal vectors of a label link with each other; an empty table gives no rows;
columns other than vec_id, embedding and label, whatever their names, are not read.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, table, written

NONE = -1


def _diverse(sim: np.ndarray, ids: np.ndarray, vec: np.ndarray, m: int) -> np.ndarray:
    """Up to m neighbours for each row of candidates (best first, NONE at the end): one is taken
    if it is nearer to the row's vector than to all taken before."""
    rows, width = ids.shape
    out = np.full((rows, m), NONE, dtype=np.int32)
    taken = np.zeros(rows, dtype=np.int64)
    chosen = np.zeros((rows, m, vec.shape[1]), dtype=np.float32)
    for k in range(width):
        c = ids[:, k]
        live = (c >= 0) & (taken < m)
        if not live.any():
            break
        v = vec[np.maximum(c, 0)]
        near = np.einsum("bmd,bd->bm", chosen, v)
        near[np.arange(m)[None, :] >= taken[:, None]] = -2
        ok = np.flatnonzero(live & (near.max(axis=1) < sim[:, k]))
        out[ok, taken[ok]] = c[ok]
        chosen[ok, taken[ok]] = v[ok]
        taken[ok] += 1
    # the nearest of those passed over fill the places left, so that dense groups hold together
    for k in range(min(width, 2 * m)):
        c = ids[:, k]
        ok = np.flatnonzero((c >= 0) & (taken < m) & ~(out == c[:, None]).any(axis=1))
        out[ok, taken[ok]] = c[ok]
        taken[ok] += 1
    return out


class Graph:
    """A navigable small-world hierarchy over unit vectors."""

    def __init__(self, vec: np.ndarray, m: int = 12, ef: int = 64, seed: int = 3):
        self.vec, self.m = np.ascontiguousarray(vec, dtype=np.float32), m
        n = len(vec)
        rng = np.random.default_rng(seed)
        level = np.floor(-np.log(1 - rng.random(n)) / np.log(m)).astype(int)
        self.order = np.argsort(-level, kind="stable")  # higher nodes come first
        self.sizes = [int((level >= x).sum()) for x in range(int(level.max(initial=0)) + 1)]
        self.rank_vec = self.vec[self.order]
        self.layers: list[np.ndarray] = [None] * len(self.sizes)
        for layer in range(len(self.sizes) - 1, -1, -1):
            self._fill(layer, ef)

    def _fill(self, layer: int, ef: int) -> None:
        n, width = self.sizes[layer], self.m * (2 if layer == 0 else 1)
        nb = np.full((n, width), NONE, dtype=np.int32)
        self.layers[layer] = nb
        at = 0
        while at < n:
            size = min(n - at, max(64, min(at, 512)))
            new = np.arange(at, at + size)
            q = self.rank_vec[new]
            inner = q @ q.T
            np.fill_diagonal(inner, -2)
            k = min(size - 1, 16) if at else min(size - 1, 64)
            ids = np.argpartition(-inner, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((size, 0), dtype=np.int64)
            sim = np.take_along_axis(inner, ids, axis=1)
            ids = ids + at
            if at:
                found, fsim = self._beam(layer, q, self._descend(q, layer + 1), ef, at)
                ids, sim = np.concatenate([found, ids], axis=1), np.concatenate([fsim, sim], axis=1)
            o = np.argsort(-sim, axis=1, kind="stable")
            ids, sim = np.take_along_axis(ids, o, axis=1), np.take_along_axis(sim, o, axis=1)
            got = _diverse(sim, ids, self.rank_vec, self.m)
            nb[new, : self.m] = got
            self._back(nb, new, got, width)
            at += size

    def _back(self, nb: np.ndarray, new: np.ndarray, got: np.ndarray, width: int) -> None:
        src, dst = np.repeat(new, got.shape[1]), got.ravel()
        keep = dst >= 0
        src, dst = src[keep], dst[keep]
        o = np.argsort(dst, kind="stable")
        src, dst = src[o], dst[o]
        crowded, wide = [], []
        for t, a, b in zip(*_runs(dst), strict=True):
            both = np.union1d(nb[t][nb[t] >= 0], src[a:b])
            if len(both) <= width:
                nb[t, : len(both)] = both
            else:
                crowded.append(t)
                wide.append(both)
        for a in range(0, len(crowded), 512):
            rows, lists = np.array(crowded[a : a + 512]), wide[a : a + 512]
            ids = np.full((len(rows), max(map(len, lists))), NONE, dtype=np.int64)
            for i, x in enumerate(lists):
                ids[i, : len(x)] = x
            sim = np.einsum("bd,bkd->bk", self.rank_vec[rows], self.rank_vec[np.maximum(ids, 0)])
            sim[ids < 0] = -3
            o = np.argsort(-sim, axis=1, kind="stable")[:, : 4 * width]
            nb[rows] = _diverse(np.take_along_axis(sim, o, axis=1), np.take_along_axis(ids, o, axis=1), self.rank_vec, width)

    def _descend(self, q: np.ndarray, down_to: int) -> np.ndarray:
        at = np.zeros((len(q), 1), dtype=np.int64)
        for layer in range(len(self.sizes) - 1, down_to - 1, -1):
            at = self._beam(layer, q, at, 4, self.sizes[layer])[0]
            at = np.maximum(at, 0)
        return at

    def _beam(self, layer: int, q: np.ndarray, entry: np.ndarray, ef: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and similarities of the best ``ef`` of the layer's first ``n`` nodes, best first."""
        nb, rows = self.layers[layer], len(q)
        r = np.arange(rows)[:, None]
        seen = np.zeros((rows, n), dtype=bool)
        spread = np.linspace(0, n - 1, min(n, 8)).astype(np.int64)
        entry = np.concatenate([np.minimum(entry, n - 1), np.repeat(spread[None], rows, axis=0)], axis=1)
        entry = np.sort(entry, axis=1)
        entry[:, 1:][entry[:, 1:] == entry[:, :-1]] = NONE
        ids = np.full((rows, ef), NONE, dtype=np.int64)
        sim = np.full((rows, ef), -3, dtype=np.float32)
        done = np.ones((rows, ef), dtype=bool)
        fresh = entry
        step = max(4, ef // 16)
        active = np.arange(rows)
        while True:
            ok = fresh >= 0
            f = np.maximum(fresh, 0)
            s = np.einsum("bd,bkd->bk", q[active], self.rank_vec[f], optimize=False)
            s[~ok] = -3
            seen[np.broadcast_to(active[:, None], f.shape)[ok], f[ok]] = True
            ids2 = np.concatenate([ids[active], np.where(ok, f, NONE)], axis=1)
            sim2 = np.concatenate([sim[active], s], axis=1)
            done2 = np.concatenate([done[active], ~ok], axis=1)
            o = np.argpartition(-sim2, ef - 1, axis=1)[:, :ef]
            ids[active], sim[active], done[active] = (np.take_along_axis(x, o, axis=1) for x in (ids2, sim2, done2))
            open_ = ~done[active]
            active = active[open_.any(axis=1)]
            if not len(active):
                break
            wait = np.where(done[active], -4, sim[active])
            k = min(step, ef)
            pick = np.argpartition(-wait, k - 1, axis=1)[:, :k]
            usable = np.take_along_axis(wait, pick, axis=1) > -3.5
            node = np.take_along_axis(ids[active], pick, axis=1)
            d = done[active]
            np.put_along_axis(d, pick, True, axis=1)
            done[active] = d
            near = np.where(usable[:, :, None], nb[np.maximum(node, 0)], NONE).reshape(len(active), -1)
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = NONE
            near[near >= n] = NONE
            near[seen[active[:, None], np.maximum(near, 0)]] = NONE
            keep = (near >= 0).sum(axis=1).max(initial=0)
            fresh = np.sort(near, axis=1)[:, near.shape[1] - keep :] if keep else np.full((len(active), 1), NONE)
        o = np.argsort(-sim, axis=1, kind="stable")
        return ids[r, o], sim[r, o]

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(node, similarity) arrays of the best ``ef`` nodes for each query; NONE where fewer."""
        q = np.asarray(q, dtype=np.float32)
        ef = min(ef, self.sizes[0])
        got, sim = self._beam(0, q, self._descend(q, 1), ef, self.sizes[0])
        return np.where(got >= 0, self.order[np.maximum(got, 0)], NONE), sim


def _runs(a: np.ndarray) -> tuple[list, list, list]:
    if not len(a):
        return [], [], []
    cut = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    return a[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(a)]


def _labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least entry of 0..n-1 that each reaches along the pairs."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _shared_beam(graph: Graph, base: np.ndarray, q: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[list, list]:
    """Links of queries that lie in dense groups. Queries that found a node in common (pairs x, y)
    have one beam: the nodes that any of them found. It is widened by the nodes that are joined to it in
    the graph as long as those bring links."""
    near = graph.layers[0]
    edge_to = np.where(near >= 0, graph.order[np.maximum(near, 0)], NONE)
    inverse = np.empty(len(graph.order), dtype=np.int64)
    inverse[graph.order] = np.arange(len(graph.order))
    label = _labels(x, y + len(q), len(q) + len(base))
    out_q, out_n = [], []
    for c in np.unique(label[x]):
        mine = np.flatnonzero(label[x] == c)
        rows = np.unique(x[mine])
        inside = np.zeros(len(base), dtype=bool)
        fresh = np.unique(y[mine])
        tried = np.zeros(len(base), dtype=bool)
        while len(fresh):
            tried[fresh] = True
            for a in range(0, len(rows), 1024):
                r = rows[a : a + 1024]
                i, j = np.nonzero(q[r] @ base[fresh].T >= threshold)
                out_q.append(r[i])
                out_n.append(fresh[j])
                inside[fresh[j]] = True
            beside = edge_to[inverse[np.flatnonzero(inside)]].ravel()
            cand = np.zeros(len(base), dtype=bool)
            cand[beside[beside >= 0]] = True
            cand[graph.order[((edge_to >= 0) & inside[np.maximum(edge_to, 0)]).any(axis=1)]] = True
            fresh = np.flatnonzero(cand & ~tried)
    return out_q, out_n


def links_of(graph: Graph, base: np.ndarray, q: np.ndarray, threshold: float, recall: float, ef: int = 48, sample: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) of all verified links. base, q: unit vectors in double precision.

    A beam that holds nothing but links is widened four times; what is still full then shares
    a beam with the queries around it."""
    n = len(base)
    low = threshold - 1e-4
    rng = np.random.default_rng(5)
    probe = rng.choice(len(q), size=min(sample, len(q)), replace=False)
    truth = q[probe] @ base.T >= threshold
    while True:
        found_q, found_n = [], []
        waiting = np.arange(len(q))
        for width in (min(ef, n), min(4 * ef, n)):
            again, full_q, full_n = [], [], []
            for a in range(0, len(waiting), size := max(16, min(1024, (1 << 22) // max(n, 64 * width)))):
                rows = waiting[a : a + size]
                ids, sim = graph.search(q[rows], width)
                full = (sim[:, -1] >= low) & (ids[:, -1] >= 0) & (width < n)
                again.append(rows[full])
                hit = (sim >= low) & (ids >= 0)
                for part, to_q, to_n in ((hit & ~full[:, None], found_q, found_n), (hit & full[:, None], full_q, full_n)):
                    x, y = np.nonzero(part)
                    to_q.append(rows[x])
                    to_n.append(ids[x, y])
            waiting = np.concatenate(again)
            if not len(waiting):
                break
        fq, fn = np.concatenate(found_q), np.concatenate(found_n)
        ok = np.concatenate([np.einsum("ij,ij->i", q[fq[a : a + 65536]], base[fn[a : a + 65536]]) >= threshold for a in range(0, len(fq), 65536)] or [np.zeros(0, bool)])
        fq, fn = fq[ok], fn[ok]
        if len(waiting):
            dense_q, dense_n = _shared_beam(graph, base, q, np.concatenate(full_q), np.concatenate(full_n), threshold)
            fq, fn = np.concatenate([fq, *dense_q]), np.concatenate([fn, *dense_n])
        # each probe with links counts alike, so that one in a dense group does not speak for the others
        got = np.zeros_like(truth)
        place = np.full(len(q), NONE)
        place[probe] = np.arange(len(probe))
        mine = place[fq] >= 0
        got[place[fq[mine]], fn[mine]] = True
        linked = truth.sum(axis=1)
        some = linked > 0
        if not some.any() or ((got & truth).sum(axis=1)[some] / linked[some]).mean() >= recall or ef >= n:
            return fq, fn
        ef *= 2


def _pack(graph: Graph) -> bytes:
    f = io.BytesIO()
    np.savez(f, order=graph.order, sizes=np.array(graph.sizes), **{f"l{i}": x for i, x in enumerate(graph.layers)})
    return f.getvalue()


def _unpack(blob: bytes, vec: np.ndarray) -> Graph:
    z = np.load(io.BytesIO(blob))
    g = Graph.__new__(Graph)
    g.vec, g.order, g.sizes = vec.astype(np.float32), z["order"], z["sizes"].tolist()
    g.layers = [z[f"l{i}"] for i in range(len(g.sizes))]
    g.rank_vec = g.vec[g.order]
    return g


def _unit(column: pd.Series) -> np.ndarray:
    v = np.stack([np.asarray(x, dtype=np.float64) for x in column])
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def near_vectors(rows: DataFrame, threshold: float = 0.98, shard: int = 8192, recall: float = 0.999, m: int = 12) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id and kept. rows: vec_id, embedding, label."""
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(
        F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0), F.lit(False)
    )
    marked = rows.withColumn("usable", usable)
    good = marked.where("usable")
    # a node has a number of its own, since vec_id may stand for several vectors
    nodes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    per = nodes.groupBy("label", F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))
    dealt = (
        nodes.withColumn("dim", F.size("embedding"))
        .join(per, ["label", "dim"])
        .withColumn("shards", F.ceil(F.col("n") / shard).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("least", "embedding"), F.col("shards")).cast("int"))
        .drop("n", "least")
    )
    dealt = written(dealt, "dealt")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        g = Graph(_unit(pdf["embedding"]), m=m)
        return pd.DataFrame(
            {"label": pdf["label"].iloc[:1], "dim": pdf["dim"].iloc[:1], "shard": pdf["block"].iloc[:1], "shards": pdf["shards"].iloc[:1], "graph": [_pack(g)]}
        )

    label_type = nodes.schema["label"].dataType.simpleString()
    graphs = written(
        dealt.groupBy("label", "dim", "block").applyInPandas(build, f"label {label_type}, dim int, shard int, shards int, graph binary"), "graphs"
    )

    def query(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        shard_, block = key[2], key[3]
        right = right.sort_values("node")
        base = right[right["block"] == shard_]
        q = base if shard_ == block else right[right["block"] == block]
        b, v = _unit(base["embedding"]), _unit(q["embedding"])
        x, y = links_of(_unpack(left["graph"].iloc[0], b), b, v, threshold, recall)
        nq, nb = q["node"].to_numpy(), base["node"].to_numpy()
        wq, wb = q["copies"].to_numpy(), base["copies"].to_numpy()
        if shard_ == block:
            code = np.unique(np.minimum(x, y)[x != y] * len(nb) + np.maximum(x, y)[x != y])
            a, c = code // len(nb), code % len(nb)
            node, w = nb, np.bincount(a, wb[c], len(nb)) + np.bincount(c, wb[a], len(nb))
        else:
            a, c = x, y + len(nq)
            node = np.concatenate([nq, nb])
            weight = np.concatenate([wq, wb])
            w = np.bincount(a, weight[c], len(node)) + np.bincount(c, weight[a], len(node))
        label = _labels(a, c, len(node))
        some = w > 0
        return pd.DataFrame({"node": node[some], "links": w[some].astype(np.int64), "to_node": node[label[some]]})

    left = graphs.withColumn("block", F.explode(F.sequence(F.col("shard"), F.col("shards") - 1)))
    # a block meets the shards up to its own, and gives the vectors of its own shard to later blocks
    meets = F.transform(F.sequence(F.lit(0), F.col("block")), lambda s: F.struct(s.alias("shard"), F.col("block").alias("with")))
    later = F.transform(F.sequence(F.col("block"), F.col("shards") - 1), lambda b: F.struct(F.col("block").alias("shard"), b.alias("with")))
    right = dealt.select("*", F.explode(F.array_distinct(F.concat(meets, later))).alias("to")).select(
        "label", "dim", F.col("to.shard").alias("shard"), F.col("to.with").alias("with"), "block", "node", "copies", "embedding"
    )
    keyed = left.withColumnRenamed("block", "with")
    found = written(
        keyed.groupBy("label", "dim", "shard", "with")
        .cogroup(right.groupBy("label", "dim", "shard", "with"))
        .applyInPandas(query, "node long, links long, to_node long"),
        "links",
    )
    comp = components(found, "node", "to_node")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    by = nodes.join(links, "node", "left").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = by.groupBy("component").agg(F.min("least").alias("component_id"))
    by = by.join(first, "component").select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = good.join(by, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = marked.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op3_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))

