"""Products of all rows of one matrix with all rows of another, in blocks.

A matrix is a table (node, v): one vector of bounded length a node. Nodes are dealt by hash to blocks of at most about BLOCK_BYTES, every pair of blocks
is multiplied in numpy, tile by tile, and of each source only its strongest edges leave the pair. No key holds all nodes. A block travels once for
each block of the other side: eight times, however many nodes there are, until eight blocks no longer hold them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

BLOCK = 512  # nodes that are not worth a block of their own
BLOCKS = 8
BLOCK_BYTES = 16 << 20
QUANTUM = 1e-4
PICK = {"signed": lambda w: np.abs(w), "abs": lambda w: np.abs(w), "positive": lambda w: w, "negative": lambda w: -w}


def histories(panel: DataFrame, x: str, rows: int, node: str = "ticker", date: str = "date") -> DataFrame:
    """(node, v): x on the last ``rows`` sessions of the panel, null as 0, by date. A node without a row on a session has a shorter vector."""
    dates = panel.select(date).distinct().orderBy(F.desc(date)).limit(rows)
    kept = panel.join(F.broadcast(dates), date)
    v = F.transform(F.array_sort(F.collect_list(F.struct(date, F.coalesce(x, F.lit(0.0)).alias("x")))), lambda s: s["x"])
    return kept.groupBy(F.col(node).alias("node")).agg(v.alias("v"))


def _mean(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, b: a + b) / F.size(v)


def centred(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_m", _mean(F.col("v"))).withColumn("v", F.transform("v", lambda x: x - F.col("_m"))).drop("_m")


def standardised(rows: DataFrame, ddof: int, least: float = 1e-8, divisor: str = "n - 1") -> DataFrame:
    """Centred vectors over their deviation (ddof 0 or 1), so that products divided by n - 1 are correlations; without vectors that hardly vary.

    Both sides carry the root of the divisor, so that a plain inner product is the measure."""
    c = centred(rows).withColumn("_n", F.size("v"))
    dev = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b) / (F.col("_n") - ddof))
    c = c.where("_n > 1").withColumn("_d", dev).where(F.col("_d") > least)
    return c.withColumn("v", F.transform("v", lambda x: x / (F.col("_d") * F.sqrt(F.col("_n") - 1)))).drop("_d", "_n")


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("node")
    width = max(map(len, pdf["v"]))
    m = np.zeros((len(pdf), width))
    for i, v in enumerate(pdf["v"]):
        m[i, : len(v)] = v
    return pd.DataFrame({"block": pdf["block"].iloc[:1], "nodes": [pdf["node"].tolist()], "width": [width], "m": [m.tobytes()]})


def packed(rows: DataFrame, blocks: int) -> DataFrame:
    kind = rows.schema["node"].dataType.simpleString()
    dealt = rows.select("node", "v", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("block"))
    return dealt.groupBy("block").applyInPandas(_pack, f"block int, nodes array<{kind}>, width int, m binary")


def _blocks(rows: DataFrame) -> int:
    """At least BLOCKS blocks where nodes suffice, so that all tasks have pairs; more only where a block would pass BLOCK_BYTES."""
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    return max(1, min(BLOCKS, -(-n // BLOCK)), -(-n * (width or 0) * 8 // BLOCK_BYTES))


def strongest_products(left: DataFrame, right: DataFrame, top: int, least: float, mode: str = "signed", scale: float = 1.0, limit: float | None = None, quantum: float | None = QUANTUM) -> DataFrame:
    """(src, dst, weight): of each left node the ``top`` strongest inner products with right nodes of another name, of size ``least`` at least; ties: larger dst.

    mode: signed, abs (weights lose their sign), positive or negative. Products are kept within +-limit, rounded to ``quantum`` (half to even) before
    selection, and scaled after it. A weight of 0 is no edge."""
    left = written(left.select("node", "v"), "left")
    same = right is None
    right = left if same else written(right.select("node", "v"), "right")
    m = _blocks(left)
    n = m if same else _blocks(right)
    kind = left.schema["node"].dataType.simpleString()
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    a = packed(left, m).select(F.col("block").alias("l"), F.col("nodes").alias("srcs"), F.col("width").alias("aw"), F.col("m").alias("am")).withColumn("r", every(n))
    b = packed(right, n).select(F.col("block").alias("r"), "nodes", "width", "m").withColumn("l", every(m))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                yield _edges(r, top, least, mode, limit, quantum)

    spark, key = left.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "1")  # a row is a pair of blocks
    try:
        pairs = a.repartition(m * n, "l", "r").join(b.repartition(m * n, "l", "r"), ["l", "r"])
        found = written(pairs.mapInPandas(run, f"src {kind}, dst {kind}, weight double"), "edges")
    finally:
        spark.conf.set(key, before)
    size = {"positive": F.col("weight"), "negative": -F.col("weight")}.get(mode, F.abs("weight"))
    w = Window.partitionBy("src").orderBy(F.desc(size), F.desc("dst"))
    return found.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= top).select("src", "dst", (F.col("weight") * scale).alias("weight"))


def _edges(r, top: int, least: float, mode: str, limit: float | None, quantum: float | None, tile: int = 512, widest: int = 4096) -> pd.DataFrame:
    """The strongest edges of the sources of one pair of blocks. Destinations come in descending order, in tiles of growing width, so that of equals the
    first stays, and only products above the least one that a source holds are looked at."""
    srcs, dsts = np.array(list(r.srcs), dtype=object), np.array(list(r.nodes), dtype=object)[::-1]
    a, b = np.frombuffer(r.am).reshape(len(srcs), r.aw), np.frombuffer(r.m).reshape(len(dsts), r.width)[::-1]
    d = min(r.aw, r.width)
    a, b = np.ascontiguousarray(a[:, :d]), np.ascontiguousarray(b[:, :d])
    place = {x: i for i, x in enumerate(dsts)}
    itself = np.array([place.get(x, -1) for x in srcs], dtype=np.int64)
    kept = []
    for s in range(0, len(srcs), tile):
        p = a[s : s + tile]
        # a product rounds up by half a quantum at most
        bar = np.full(len(p), least - (quantum or 0.0) if top else np.inf)
        full = np.zeros(len(p), dtype=bool)
        hi, hj, hw = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        at, width = 0, 64
        while at < len(dsts):
            w = p @ b[at : at + width].T
            size = PICK[mode](w)
            i, j = np.nonzero(np.where(full[:, None], size > bar[:, None], size >= bar[:, None]) if not full.all() else size > bar[:, None])
            if len(i):
                v = w[i, j]
                if limit is not None:
                    v = np.clip(v, -limit, limit)
                if quantum:
                    v = np.rint(v / quantum) * quantum
                j = j + at
                got = PICK[mode](v)
                ok = (got >= least) & (got > 0) & (itself[s + i] != j)
                hi, hj, hw = np.append(hi, i[ok]), np.append(hj, j[ok]), np.append(hw, v[ok])
                o = np.lexsort((hj, -PICK[mode](hw), hi))
                hi, hj, hw = hi[o], hj[o], hw[o]
                rank = np.arange(len(hi)) - np.searchsorted(hi, hi, "left")
                last = rank == top - 1
                bar[hi[last]] = PICK[mode](hw[last])
                full[hi[last]] = True
                hi, hj, hw = hi[rank < top], hj[rank < top], hw[rank < top]
            at += width
            width = min(widest, at)
        kept.append(pd.DataFrame({"src": srcs[s + hi], "dst": dsts[hj], "weight": np.abs(hw) if mode == "abs" else hw}))
    return pd.concat(kept)


def partial_rows(rows: DataFrame, ridge: float = 1e-6) -> DataFrame:
    """Vectors whose inner products are the partial correlations of the nodes, given all others, with ``ridge`` on the covariance's diagonal.

    The covariance of N nodes over T sessions is ridge * 1 + H'H / (T - 1) with H of T rows; its inverse is (1 - H'MH) / ridge where M is the
    inverse of a matrix of T x T only, H H' + ridge * (T - 1) * 1. H H' is summed over tasks, one T x T matrix each; with M = L'L (from g's
    eigenvectors) and diagonal d of the inverse, the vectors L h / sqrt(ridge * d) have the products wanted. All histories are of one length."""
    c = written(centred(rows), "histories")
    t = c.select(F.max(F.size("v"))).first()[0] or 0

    def gram(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((t, t))
        for pdf in frames:
            h = np.array(pdf["v"].tolist()).reshape(len(pdf), t)
            total += h.T @ h
        yield pd.DataFrame({"g": [total.ravel()]})

    sums = [np.asarray(r["g"]) for r in c.select("v").coalesce(64).mapInPandas(gram, "g array<double>").collect()]  # 64 matrices at most
    g = np.sum(sums, axis=0).reshape(t, t) + ridge * max(t - 1, 1) * np.eye(t)
    size, axes = np.linalg.eigh(g)
    root = (axes / np.sqrt(np.maximum(size, ridge * 1e-6))).T

    def turn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            u = np.array(pdf["v"].tolist()).reshape(len(pdf), t) @ root.T
            diagonal = np.clip((1 - (u * u).sum(axis=1)) / ridge, 1e-12, None)
            yield pd.DataFrame({"node": pdf["node"], "v": list(u / np.sqrt(ridge * diagonal)[:, None])})

    kind = rows.schema["node"].dataType.simpleString()
    return c.select("node", "v").mapInPandas(turn, f"node {kind}, v array<double>")


def correlation_edges(rows: DataFrame, top: int = 6, least: float = 0.2, mode: str = "signed") -> DataFrame:
    return strongest_products(standardised(rows, 1), None, top, least, mode)


def partial_correlation_edges(rows: DataFrame, top: int, least: float = 0.1, mode: str = "signed", scale: float = 0.5) -> DataFrame:
    return strongest_products(partial_rows(rows), None, top, least, mode, scale)


def lead_lag_edges(rows: DataFrame, top: int, lag: int = 1, least: float = 0.08, mode: str = "signed", scale: float = 0.5) -> DataFrame:
    """Correlation of src with dst ``lag`` rows later, by population deviations over n - 1: a convention of the measure."""
    lead = rows.withColumn("v", F.slice("v", F.lit(1), F.greatest(F.size("v") - lag, F.lit(0))))
    late = rows.withColumn("v", F.slice("v", F.lit(lag + 1), F.greatest(F.size("v") - lag, F.lit(0))))
    return strongest_products(standardised(lead, 0), standardised(late, 0), top, least, mode, scale)


def factor_edges(factors: DataFrame, stocks: DataFrame, top: int, least: float = 0.15, mode: str = "signed", scale: float = 0.5, placebo: int = 0) -> DataFrame:
    """Edges from each factor to the stocks whose histories move with its own most; placebo: a seed by which destinations are exchanged.

    The placebo keeps sources, their numbers of edges and the weights. Each factor has a bijection of all stocks of its own, place p to
    (a * p + b) modulo their number, with a prime to it, so that distinct destinations stay distinct whenever it is applied."""
    e = strongest_products(standardised(factors, 0), standardised(stocks, 0), top, least, mode, scale, limit=1.0)
    if not placebo:
        return e
    places = stocks.select("node").distinct().withColumn("p", F.row_number().over(Window.orderBy("node")) - 1)  # one row a stock
    places = written(places, "places")
    n = places.count()
    steps = [p for p in (1_000_003, 1_000_033, 1_000_037, 1_000_039, 1_000_081) if n % p]  # primes that do not divide n
    h = lambda salt: F.xxhash64(F.lit(placebo), F.lit(salt), F.col("src").cast("string"))
    a = F.element_at(F.array(*[F.lit(x) for x in steps]), (F.pmod(h("a"), F.lit(len(steps))) + 1).cast("int"))
    moved = e.join(places.withColumnRenamed("node", "dst"), "dst").withColumn("q", ((a * F.col("p") + F.pmod(h("b"), F.lit(max(n, 1)))) % max(n, 1)).cast("long"))
    return moved.select("src", "q", "weight").join(places.select(F.col("node").alias("dst"), F.col("p").alias("q")), "q").select("src", "dst", "weight")
