"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so its size follows
the text, sketches of parts merge by union, and containment can be estimated between texts of
very unequal length. The fingerprint string lists the number of distinct shingles, the least
shingle hash and the kept hashes, in hexadecimal, ascending.

Likeness of two sketches is the Jaccard index of their kept hashes; if neither keeps any (short
texts), it is 1 for equal number and least hash, else 0.

Rules for odd input: null text counts as empty; texts without words share the fingerprint of
the empty set and are alike to each other; a text of 1 to 4 words has one shingle; rows with equal or
null doc_id are ordered by text among themselves, null ids first; texts of any length are read whole; an empty table
gives no rows; columns other than doc_id and text, whatever their names, are not read. A text with few shingles may keep none:
its likeness to an edited text is then 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, doc_slices, exact_id, id_again, lean, shingles_of, table, text_chunks, words_of

ONE_IN = 8


class Sketch:
    __slots__ = ("n", "low", "kept")

    def __init__(self, n: int, low: int, kept: np.ndarray):
        self.n, self.low, self.kept = n, low, kept

    def __str__(self) -> str:
        return f"{self.n:x}:{self.low:x}:" + ",".join(f"{x:x}" for x in self.kept.tolist())


def sketches(texts: list[str | None], k: int = 5, one_in: int = ONE_IN) -> list[Sketch]:
    out: list[Sketch] = []
    limit = U64((1 << 64) // one_in)
    for a, b in text_chunks(texts, texts):
        h, d = shingles_of(words_of(texts[a:b]), k)
        off = doc_slices(d, b - a)
        for i in range(b - a):
            x = np.unique(h[off[i] : off[i + 1]])
            out.append(Sketch(len(x), int(x[0]) if len(x) else 0, x[: np.searchsorted(x, limit)]))
    return out


def read_sketch(fingerprint: str) -> Sketch:
    n, low, kept = fingerprint.split(":")
    return Sketch(int(n, 16), int(low, 16), np.array([int(x, 16) for x in kept.split(",") if x], dtype=U64))


def merged(a: Sketch, b: Sketch) -> Sketch:
    """The sketch of both texts' shingles together (n is then a bound from above)."""
    return Sketch(a.n + b.n, min(x.low for x in (a, b) if x.n) if a.n or b.n else 0, np.union1d(a.kept, b.kept))


def likeness(a: Sketch, b: Sketch) -> float:
    if not len(a.kept) and not len(b.kept):
        return float(a.n == b.n and a.low == b.low)
    both = len(np.intersect1d(a.kept, b.kept, assume_unique=True))
    return both / (len(a.kept) + len(b.kept) - both)


def containment(a: Sketch, b: Sketch) -> float:
    """Share of a's shingles that b holds; of the smaller set if a keeps none."""
    if not len(a.kept):
        return likeness(a, b)
    return len(np.intersect1d(a.kept, b.kept, assume_unique=True)) / len(a.kept)


def fingerprints(docs: DataFrame, k: int = 5, one_in: int = ONE_IN) -> DataFrame:
    """doc_id, n_chars, fingerprint of each row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts = pdf["text"].tolist()
            yield pdf[["doc_id", "no_id"]].assign(n_chars=[len(t or "") for t in texts], fingerprint=[str(s) for s in sketches(texts, k, one_in)])

    got = docs.select(*exact_id(), "text").mapInPandas(lean(run), "doc_id long, no_id boolean, n_chars long, fingerprint string")
    return got.select(id_again(), "n_chars", "fingerprint")


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows (part, doc_id, text, ahead) in parts of ascending doc_id. The first row of each part
    is also dealt to the part before it, and the very first to the last, marked ``ahead``."""
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    cuts = docs.select("doc_id").agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else []
    cuts = sorted(set(cuts or []))
    part = F.coalesce(F.size(F.filter(F.lit(cuts).cast("array<long>"), lambda c: c < F.col("doc_id"))), F.lit(0)) if cuts else F.lit(0)
    ids = docs.select("doc_id", part.cast("int").alias("part"))
    # the least id of each part: as many rows as there are parts
    firsts = sorted((r["part"], r["low"], r["nulls"]) for r in ids.groupBy("part").agg(F.min("doc_id").alias("low"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).collect())
    before = {p: firsts[i - 1][0] for i, (p, _, _) in enumerate(firsts)}
    copy = None
    for p, low, nulls in firsts:
        is_first = (F.col("part") == p) & (F.col("doc_id").isNull() if nulls else F.col("doc_id") == low)
        to = F.struct(F.lit(before[p]).alias("part"), F.lit(True).alias("ahead"))
        copy = F.when(is_first, to) if copy is None else copy.when(is_first, to)
    here = F.struct(F.col("part").alias("part"), F.lit(False).alias("ahead"))
    rows = docs.select("doc_id", "text", part.cast("int").alias("part"))
    if copy is None:
        return rows.withColumn("ahead", F.lit(False)), n
    rows = rows.withColumn("to", F.explode(F.array_compact(F.array(here, copy))))
    return rows.select(F.col("to.part").alias("part"), "doc_id", "text", F.col("to.ahead").alias("ahead")), n


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    rows, n = with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    columns = ["doc_id", "no_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained_edited", "contained_next"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []  # the last row of a part, waiting for the next document

        def out(batch: list[tuple]) -> pd.DataFrame:
            # batch: rows with their successors' texts
            texts = [t for _, t, _ in batch]
            following = [x for _, _, x in batch]
            edited = [t[: len(t) - len(t) // 4] + x[: len(t) // 4] for t, x in zip(texts, following, strict=True)]
            a, e = sketches(texts, 5), sketches(edited, 5)
            # the successor is the next row as a rule
            f = [a[i + 1] if i + 1 < len(a) and following[i] is texts[i + 1] else None for i in range(len(a))]
            odd = [i for i, x in enumerate(f) if x is None]
            for i, s in zip(odd, sketches([following[i] for i in odd], 5), strict=True):
                f[i] = s
            got = [
                (doc or 0, doc is None, len(t), hashlib.sha256(d.encode("utf-8", "replace")).hexdigest(), str(x), str(y), likeness(x, y), likeness(x, z), containment(x, y), containment(x, z))
                for (doc, t, _), d, x, y, z in zip(batch, edited, a, e, f, strict=True)
            ]
            return pd.DataFrame(got, columns=columns)

        part = None
        for pdf in frames:
            batch, size = [], 0
            for p, doc, no_id, text, ahead in zip(*(pdf[c].tolist() for c in ("part", "doc_id", "no_id", "text", "ahead")), strict=True):
                text = text or ""
                if p != part:
                    part, held = p, []
                if held:
                    batch.append((*held[0], text))
                    size += len(text)
                held = [] if ahead else [(None if no_id else doc, text)]
                if ahead:
                    part = None if p is None else part
                if size > 1 << 20:
                    yield out(batch)
                    batch, size = [], 0
            if batch:
                yield out(batch)

    # a part's own rows come first, in order, then the first row of the next part
    dealt = rows.repartition(n, "part").sortWithinPartitions("part", "ahead", F.col("doc_id").asc_nulls_first(), "text")
    got = dealt.select("part", *exact_id(), "text", "ahead").mapInPandas(
        lean(run),
        "doc_id long, no_id boolean, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double, contained_next double",
    )
    return got.select(id_again(), *columns[2:])
