"""Hard negatives by sorting each anchor's scores.

Components become integers, so that scores are exact and ties are real ones. Rows are packed in blocks of about 8,192, anchors
in groups of about 1,024. A task holds some of the groups and reads some of the blocks, one after the other; a block and 128 anchors are one
matrix product. The first pass multiplies rows of the anchor's label and keeps each anchor's first ones, the positives; the second
keeps, for each positive, the first rows of other labels between its limits. What a score must be at least (the limit, or the last one
held when enough are held) is known before the scores are sorted, so that only those are sorted by score and id that may be among
the first. A task gives its first rows once, when it has read all its blocks, and the first of all tasks are the result.

What is sent is the blocks once for each part of the anchors (65,536 at most) and the anchors once for each part of the blocks, in at most 128 tasks. The
products are a square of the rows, a fiftieth of them anchors.

Rules for odd input: rows without id, label or vector, or with a null or non-finite component, take no part; an
empty vector scores 0 with all; of vectors of different lengths the common components count; components and scores beyond 64
bits are kept at the limits of a long; of rows that share an id the one with the least (label, vector) takes part; an anchor
without other rows of its label gives no rows; an empty table gives none; columns other than the three, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, parts, table, written

BLOCK, ANCHORS, TILE = 8192, 1024, 128
PART, TASKS, WORK = 1 << 16, 128, 1 << 22  # anchors of a task at most, tasks at most, scores of a task at least
LONG = (1 << 63) - 1
PACK = {"block": "int", "ids": "binary", "labels": "binary", "width": "int", "size": "int", "parts": "binary", "wanted": "binary", "n_wanted": "binary"}
SCHEMA = ", ".join(f"{c} {t}" for c, t in PACK.items())


def integer_rows(vectors: DataFrame, vec: Column, scale: int) -> DataFrame:
    """vec_id, label, parts: one row an id, components floor(scale * x)."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vec.isNotNull() & F.coalesce(finite, F.lit(False)))
    parts = F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = ok.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(F.col("label").cast("long").alias("label"), parts.alias("parts")).alias("row"))
    return rows.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.*")


def _lists(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The entries of a column of lists, and the length of each list."""
    lists = column.combine_chunks()
    return lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def _pack(rows: pa.Table) -> pa.Table:
    """The rows of a block as one, by label and id, components in as few bytes as they take."""
    ids, labels = rows["vec_id"].to_numpy().astype(np.int64), rows["label"].to_numpy().astype(np.int64)
    values, n = _lists(rows["parts"])
    filled = np.zeros((len(ids), int(n.max(initial=0))), dtype=np.int64)
    filled[np.arange(filled.shape[1]) < n[:, None]] = values.to_numpy(zero_copy_only=False)
    low, high = filled.min(initial=0), filled.max(initial=0)
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    o = np.lexsort((ids, labels))
    row = {"block": rows["block"][0].as_py(), "ids": ids[o].tobytes(), "labels": labels[o].tobytes(), "width": filled.shape[1], "size": np.dtype(kind).itemsize, "parts": filled[o].astype(kind).tobytes()}
    row |= {"wanted": None, "n_wanted": None}
    if "wanted" in rows.column_names:
        pairs, n = _lists(rows["wanted"])
        pairs = np.stack([pc.struct_field(pairs, c).to_numpy(zero_copy_only=False) for c in ("vec_id", "score")], 1).astype(np.int64)
        by = np.argsort(np.repeat(np.argsort(o), n), kind="stable")
        row |= {"wanted": pairs[by].tobytes(), "n_wanted": n[o].tobytes()}
    types = {"int": pa.int32(), "binary": pa.binary()}
    return pa.table({c: pa.array([row[c]], types[t]) for c, t in PACK.items()})


def packed(rows: DataFrame, blocks: int) -> DataFrame:
    """Rows in blocks of like size, one row a block."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInArrow(_pack, SCHEMA)


class Block:
    """Rows of one or several packs."""

    def __init__(self, packs: list):
        width = max(p.width for p in packs)
        read = lambda c: np.concatenate([np.frombuffer(getattr(p, c), np.int64) for p in packs])
        self.ids, self.labels = read("ids"), read("labels")
        raw = [np.frombuffer(p.parts, f"i{p.size}").reshape(len(p.ids) // 8, p.width) for p in packs]
        self.parts = np.concatenate([np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in raw])
        if packs[0].wanted is not None:
            pairs, n = read("wanted").reshape(-1, 2), read("n_wanted")
            self.wanted = np.zeros((len(n), int(n.max(initial=0)), 2), dtype=np.int64)
            self.asked = np.arange(self.wanted.shape[1]) < n[:, None]
            self.wanted[self.asked] = pairs
        if len(packs) > 1:
            o = np.lexsort((self.ids, self.labels))
            self.ids, self.labels, self.parts = self.ids[o], self.labels[o], self.parts[o]
            if packs[0].wanted is not None:
                self.wanted, self.asked = self.wanted[o], self.asked[o]
        self.norms = np.sqrt((self.parts.astype(np.float64) ** 2).sum(axis=1))
        self._as: dict = {}

    def part(self, kind: type, a: int, b: int, width: int) -> np.ndarray:
        if kind not in self._as:
            self._as[kind] = self.parts.astype(kind)
        return self._as[kind][a:b, :width]


def scores(x: Block, a: int, b: int, y: Block, c: int, d: int) -> np.ndarray:
    """Inner products of rows a .. b-1 of x and c .. d-1 of y, exact, kept at the limits of a long. No sum of some of the products is
    greater than that of the norms, so that small ones are exact in floating point in whatever order they are added."""
    bound = float(x.norms[a:b].max()) * float(y.norms[c:d].max()) * 1.000001
    width = min(x.parts.shape[1], y.parts.shape[1])
    for kind, limit in ((np.float32, 1 << 24), (np.float64, 1 << 53)):
        if bound < limit:
            return x.part(kind, a, b, width) @ y.part(kind, c, d, width).T
    exact = x.parts[a:b, :width].astype(object) @ y.parts[c:d, :width].astype(object).T
    return np.clip(exact, -LONG, LONG).astype(np.int64) if width else np.zeros((b - a, d - c), dtype=np.int64)


def at_least(s: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the scores that are at least their row's."""
    bound = {4: 1 << 24, 8: 1 << 53}[s.itemsize] if s.dtype.kind == "f" else LONG
    at = np.flatnonzero(s >= np.clip(least, -bound, bound).astype(s.dtype)[:, None])
    row, column = np.divmod(at, s.shape[1])
    return row, column, s.ravel()[at].astype(np.int64)


class Firsts:
    """For each slot the first k of the rows it was given, by score descending and id ascending."""

    def __init__(self, least: np.ndarray, k: int):
        """least: the scores below which nothing is taken."""
        self.k, self.least, self.last_id = k, least.copy(), np.full(len(least), LONG)
        self.held, self.waiting = (np.zeros(0, dtype=np.int64),) * 3, []

    def may(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether a row is before the last one that is held."""
        least = self.least[slot]
        return (score > least) | (score == least) & (ids <= self.last_id[slot])

    def first(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        o = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[o], score[o], ids[o]
        keep = np.arange(len(slot)) - np.searchsorted(slot, slot, "left") < self.k
        return slot[keep], score[keep], ids[keep]

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if len(slot):
            self.waiting.append(self.first(slot, score, ids))

    def merge(self, always: bool = False) -> None:
        if not self.waiting or not always and 2 * sum(len(x[0]) for x in self.waiting) < len(self.held[0]):
            return
        self.held = slot, score, ids = self.first(*(np.concatenate(x) for x in zip(self.held, *self.waiting, strict=True)))
        self.waiting = []
        last = np.flatnonzero(np.append(slot[1:] != slot[:-1], True))
        full = last[np.diff(last, prepend=-1) == self.k]
        self.least[slot[full]], self.last_id[slot[full]] = score[full], ids[full]


class Positives:
    """The first k other rows of each anchor's label."""

    columns = "anchor_id long, vec_id long, score long"

    def __init__(self, anchors: Block, k: int):
        self.anchors, self.firsts = anchors, Firsts(np.full(len(anchors.ids), -LONG), k)

    def read(self, rows: Block) -> None:
        x, f = self.anchors, self.firsts
        for label in np.intersect1d(x.labels, rows.labels).tolist():
            (low, high), (c, d) = (np.searchsorted(y.labels, [label, label + 1]) if label < LONG else (np.searchsorted(y.labels, label), len(y.labels)) for y in (x, rows))
            for a in range(low, high, TILE):
                b = min(a + TILE, high)
                at, col, score = at_least(scores(x, a, b, rows, c, d), f.least[a:b])
                slot, ids = a + at, rows.ids[c + col]
                ok = f.may(slot, score, ids) & (ids != x.ids[slot])
                f.add(slot[ok], score[ok], ids[ok])
        f.merge()

    def found(self) -> pd.DataFrame:
        self.firsts.merge(always=True)
        slot, score, ids = self.firsts.held
        return pd.DataFrame({"anchor_id": self.anchors.ids[slot], "vec_id": ids, "score": score})


class Negatives:
    """For each positive the first k rows of another label between its limits."""

    columns = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"

    def __init__(self, anchors: Block, k: int, low: tuple[int, int], high: tuple[int, int]):
        self.anchors, asked = anchors, anchors.asked
        p = anchors.wanted[..., 1].astype(object)
        limit = lambda x, none: np.where(asked, np.clip(x, -LONG, LONG).astype(np.int64), none)
        self.upper, lower = limit(high[0] * p // high[1], -LONG - 1), limit(-(-low[0] * p // low[1]), LONG)
        self.firsts = Firsts(lower.ravel(), k)

    def read(self, rows: Block) -> None:
        x, f, n = self.anchors, self.firsts, self.upper.shape[1]
        for a in range(0, len(x.ids), TILE):
            b = min(a + TILE, len(x.ids))
            least = f.least[a * n : b * n].reshape(-1, n).min(axis=1)
            at, col, score = at_least(scores(x, a, b, rows, 0, len(rows.ids)), least)
            ids = rows.ids[col]
            other = (rows.labels[col] != x.labels[a + at]) & (score <= self.upper[a:b].max(axis=1)[at])
            at, score, ids = at[other], score[other], ids[other]
            for j in range(n):
                slot = (a + at) * n + j
                ok = (score <= self.upper[a + at, j]) & f.may(slot, score, ids)
                f.add(slot[ok], score[ok], ids[ok])
        f.merge()

    def found(self) -> pd.DataFrame:
        self.firsts.merge(always=True)
        slot, score, ids = self.firsts.held
        at = np.divmod(slot, max(self.upper.shape[1], 1))
        return pd.DataFrame({"anchor_id": self.anchors.ids[at[0]], "positive_id": self.anchors.wanted[(*at, 0)], "positive_score": self.anchors.wanted[(*at, 1)], "negative_id": ids, "negative_score": score})


def _each_part(anchors: DataFrame, rows: DataFrame, across: int, down: int, start, schema: str, name: str) -> DataFrame:
    """What ``start`` of a part of the anchor groups has found when it has read a part of the blocks, for every two parts; written."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    x = anchors.select(F.lit(False).alias("row"), F.pmod("block", F.lit(across)).alias("i"), every(down).alias("j"), *PACK)
    y = rows.select(F.lit(True).alias("row"), every(across).alias("i"), F.pmod("block", F.lit(down)).alias("j"), *PACK)
    met = x.union(y).select((F.col("i") * down + F.col("j")).alias("task"), "row", *PACK)
    met = met.repartitionByRange(across * down, "task").sortWithinPartitions("task", "row")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, held, state = None, [], None
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                if r.task != task:
                    if state:
                        yield state.found()
                    task, held, state = r.task, [], None
                if not r.row:
                    held.append(r)
                elif held or state:
                    state = state or start(Block(held))
                    held = []
                    state.read(Block([r]))
        if state:
            yield state.found()

    spark, key = rows.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "4")  # a row is a block of some megabytes
    try:
        return written(met.mapInPandas(lean(run), schema), name)
    finally:
        spark.conf.set(key, before)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ``integer_rows``.

    A positive is one of the anchor's first ``positives`` other rows of its label; its negatives are the first ``negatives`` rows
    of another label whose score s satisfies low[0] * p <= low[1] * s and high[1] * s <= high[0] * p, p being the positive's."""
    rows = written(rows, "rows")
    chosen = rows.where(is_anchor)
    n, n_anchors = rows.count(), chosen.count()
    blocks, groups = max(1, -(-n // BLOCK)), max(1, -(-n_anchors // ANCHORS))
    tasks = max(1, min(TASKS, parts(rows), -(-n * n_anchors // WORK)))
    # a part of the anchors costs the bytes of all rows, one of the rows about an eighth of that: all anchors and what was found for them
    across = min(groups, max(-(-n_anchors // PART), round((tasks / 8) ** 0.5), 1))
    down = min(blocks, -(-tasks // across))
    packs = written(packed(rows, blocks), "row_blocks")
    own = _each_part(packed(chosen, groups), packs, across, down, lambda b: Positives(b, positives), Positives.columns, "positives")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    top = own.withColumn("i", F.row_number().over(best)).where(F.col("i") <= positives)
    wanted = top.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("vec_id", "score")).alias("wanted"))
    asked = packed(chosen.join(wanted, "vec_id"), groups)
    found = _each_part(asked, packs, across, down, lambda b: Negatives(b, negatives, low, high), Negatives.columns, "negatives")
    w = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    moved = e.select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding")
    return hard_negatives(integer_rows(moved, F.col("embedding"), 256), F.col("vec_id") % 50 == 0)


OP12_SQL = """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score FROM r AS a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
 p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
 SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
 FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
 WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY rank <= 3"""
